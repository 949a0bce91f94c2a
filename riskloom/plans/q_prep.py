"""Imputation, encoding, scaling and data-dependent binning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import binning as B
from ..operators import encode as E
from ..operators import impute as I
from ..operators import scale as S
from .common import r6, t, vx, with_vitals
from .registry import register

# Customer with induced missing values: balance (every 11th), segment
# (every 7th) and nation key (every 13th).
CZ_SQL = ("cz AS (SELECT c_custkey, c_name, c_mktsegment, "
          "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey, "
          "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, "
          "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer)")


def cz(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select("c_custkey", "c_name", "c_mktsegment",
                    F.when(k % 13 != 0, F.col("c_nationkey")).alias("c_nationkey"),
                    F.when(k % 11 != 0, F.col("c_acctbal")).alias("c_acctbal"),
                    F.when(k % 7 != 0, F.col("c_mktsegment")).alias("segment"))


@register("group_median", f"""WITH {CZ_SQL}
SELECT c_nationkey, round(median(c_acctbal), 6) AS median_acctbal FROM cz
WHERE c_nationkey IS NOT NULL GROUP BY c_nationkey""", "D3")
def q_group_median(spark, sf_dir):
    m = I.group_median(cz(spark, sf_dir), "c_acctbal", ["c_nationkey"], "median_acctbal")
    return m.withColumn("median_acctbal", r6("median_acctbal"))


@register("mode_median", f"""WITH {CZ_SQL}
SELECT round(median(c_acctbal), 6) AS median_acctbal, round(avg(c_acctbal), 6) AS mean_acctbal,
  (SELECT segment FROM cz WHERE segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1) AS mode_segment,
  (SELECT c_nationkey FROM cz WHERE c_nationkey IS NOT NULL GROUP BY c_nationkey ORDER BY count(*) DESC, c_nationkey LIMIT 1) AS mode_nation
FROM cz""", "D4")
def q_mode_median(spark, sf_dir):
    d = cz(spark, sf_dir)
    st = I.global_stats(d, medians=["c_acctbal"], modes=["segment", "c_nationkey"], means=["c_acctbal"])
    return d.agg(F.count(F.lit(1)).alias("_n")).select(
        F.round(F.lit(st["median__c_acctbal"]).cast("double"), 6).alias("median_acctbal"),
        F.round(F.lit(st["mean__c_acctbal"]).cast("double"), 6).alias("mean_acctbal"),
        F.lit(st["mode__segment"]).cast("string").alias("mode_segment"),
        F.lit(st["mode__c_nationkey"]).cast("int").alias("mode_nation"))


@register("group_median_impute", f"""WITH {CZ_SQL},
m AS (SELECT c_nationkey, median(c_acctbal) AS med FROM cz WHERE c_nationkey IS NOT NULL GROUP BY c_nationkey)
SELECT c_custkey, cz.c_nationkey AS c_nationkey, round(coalesce(c_acctbal, m.med), 6) AS c_acctbal
FROM cz LEFT JOIN m ON cz.c_nationkey = m.c_nationkey""", "E1 K4")
def q_group_median_impute(spark, sf_dir):
    d = I.fill_group_median(cz(spark, sf_dir), "c_acctbal", ["c_nationkey"])
    return d.select("c_custkey", "c_nationkey", r6("c_acctbal").alias("c_acctbal"))


_FB_NULL = "c_custkey % 11 = 0 OR (c_nationkey = 3 AND c_mktsegment = 'BUILDING') OR c_nationkey = 7"


@register("group_median_fallback", f"""WITH x AS (SELECT c_custkey, c_nationkey, c_mktsegment,
  CASE WHEN {_FB_NULL} THEN NULL ELSE c_acctbal END AS bal FROM customer),
f AS (SELECT c_nationkey, c_mktsegment, median(bal) AS m1 FROM x GROUP BY 1, 2),
c AS (SELECT c_nationkey, median(bal) AS m2 FROM x GROUP BY 1),
g AS (SELECT median(bal) AS m3 FROM x)
SELECT x.c_custkey, round(coalesce(x.bal, f.m1, c.m2, g.m3), 6) AS bal
FROM x LEFT JOIN f ON x.c_nationkey = f.c_nationkey AND x.c_mktsegment = f.c_mktsegment
LEFT JOIN c ON x.c_nationkey = c.c_nationkey CROSS JOIN g""", "C2 E2 K5")
def q_group_median_fallback(spark, sf_dir):
    cu = t(spark, sf_dir, "customer")
    null_rule = ((F.col("c_custkey") % 11 == 0)
                 | ((F.col("c_nationkey") == 3) & (F.col("c_mktsegment") == "BUILDING"))
                 | (F.col("c_nationkey") == 7))
    x = cu.select("c_custkey", "c_nationkey", "c_mktsegment",
                  F.when(~null_rule, F.col("c_acctbal")).alias("bal"))
    d = I.fill_group_median(x, "bal", ["c_nationkey", "c_mktsegment"], fallbacks=[["c_nationkey"]],
                            global_fallback=True)
    return d.select("c_custkey", r6("bal").alias("bal"))


@register("fill_const", f"""WITH {CZ_SQL}
SELECT c_custkey, coalesce(c_acctbal, 0.0) AS c_acctbal, coalesce(segment, 'None') AS segment FROM cz""", "K1")
def q_fill_const(spark, sf_dir):
    d = I.fill_const(cz(spark, sf_dir), {"c_acctbal": 0.0, "segment": "None", "absent_col": 1})
    return d.select("c_custkey", "c_acctbal", "segment")


@register("fill_median_mode", f"""WITH {CZ_SQL},
md AS (SELECT median(c_acctbal) AS m FROM cz),
mo AS (SELECT segment AS s FROM cz WHERE segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1)
SELECT c_custkey, round(coalesce(c_acctbal, md.m), 6) AS c_acctbal, coalesce(segment, mo.s) AS segment
FROM cz, md, mo""", "K2 K3")
def q_fill_median_mode(spark, sf_dir):
    d = cz(spark, sf_dir)
    d = I.fill_mode(I.fill_median(d, ["c_acctbal"]), ["segment"], default="missing")
    return d.select("c_custkey", r6("c_acctbal").alias("c_acctbal"), "segment")


@register("sentinel_median", with_vitals("""
, md AS (SELECT median(chol) AS m FROM vx)
SELECT id, round(CASE WHEN chol = 0 THEN md.m ELSE chol END, 6) AS chol FROM vx, md"""), "K6")
def q_sentinel_median(spark, sf_dir):
    v = vx(spark, sf_dir).select("id", "chol")
    return I.fill_sentinel_median(v, "chol", 0).select("id", r6(F.col("chol").cast("double")).alias("chol"))


@register("label_encode", f"""WITH {CZ_SQL}
SELECT c_custkey,
  CAST(dense_rank() OVER (ORDER BY coalesce(segment, 'nan')) - 1 AS INTEGER) AS segment,
  CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INTEGER) AS c_name
FROM cz""", "J1")
def q_label_encode(spark, sf_dir):
    d = cz(spark, sf_dir).select("c_custkey", "segment", "c_name")
    return E.label_encode(d, ["segment", "c_name"]).select("c_custkey", "segment", "c_name")


# Ordinal scale for the priority text ('4-NOT SPECIFIED' is
# deliberately unmapped and gets the default).
PRIORITY_ORDINAL = {"5-LOW": 1, "3-MEDIUM": 3, "2-HIGH": 4, "1-URGENT": 5}


@register("ordinal_encode", """
SELECT o_orderkey, coalesce(CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 3 WHEN '2-HIGH' THEN 4
       WHEN '1-URGENT' THEN 5 END, 0) AS o_orderpriority FROM orders""", "J2")
def q_ordinal_encode(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return E.ordinal_encode(o, {"o_orderpriority": PRIORITY_ORDINAL})


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@register("one_hot", "SELECT p_partkey, " + ", ".join(
    f"CASE WHEN p_partkey % 9 <> 0 AND p_type = '{v}' THEN 1 ELSE 0 END AS p_type_{v}" for v in _TYPES)
    + " FROM part", "J3")
def q_one_hot(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    p = p.select("p_partkey", F.when(F.col("p_partkey") % 9 != 0, F.col("p_type")).alias("p_type"))
    return E.one_hot(p, ["p_type"])


@register("freq_encode", """
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_brand END AS p_brand FROM part),
c AS (SELECT p_brand, count(*) AS n FROM p WHERE p_brand IS NOT NULL GROUP BY p_brand)
SELECT p.p_partkey, p.p_brand, CAST(c.n AS BIGINT) AS p_brand_count FROM p LEFT JOIN c ON p.p_brand = c.p_brand""",
    "C1")
def q_freq_encode(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    p = p.select("p_partkey", F.when(F.col("p_partkey") % 13 != 0, F.col("p_brand")).alias("p_brand"))
    return E.freq_encode(p, "p_brand").select("p_partkey", "p_brand", "p_brand_count")


_SCALE_COLS = ["l_quantity", "l_extendedprice"]
# Fit on the earlier shipments, apply to all rows (a temporal train split).
_TRAIN = "l_shipdate < DATE '1997-01-01'"


@register("standard_scale", "WITH s AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _SCALE_COLS)
    + f" FROM lineitem WHERE {_TRAIN})\nSELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 6) AS {c}" for c in _SCALE_COLS)
    + " FROM lineitem, s", "J4 J5")
def q_standard_scale(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", *_SCALE_COLS)
    out = S.standard_scale(li, _SCALE_COLS, fit=li.where(_TRAIN))
    return out.select("l_orderkey", "l_linenumber", *[r6(c).alias(c) for c in _SCALE_COLS])


@register("robust_scale", "WITH s AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) AS b_{c}"
    for c in _SCALE_COLS) + f" FROM lineitem WHERE {_TRAIN})\nSELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c} - m_{c}) / CASE WHEN b_{c} - a_{c} = 0 THEN 1 ELSE b_{c} - a_{c} END, 6) AS {c}"
    for c in _SCALE_COLS) + " FROM lineitem, s", "J6")
def q_robust_scale(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", *_SCALE_COLS)
    out = S.robust_scale(li, _SCALE_COLS, fit=li.where(_TRAIN))
    return out.select("l_orderkey", "l_linenumber", *[r6(c).alias(c) for c in _SCALE_COLS])


_SKEW_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _skew_sql(c):
    return f"avg(pow({c} - m_{c}, 3)) / pow(avg(pow({c} - m_{c}, 2)), 1.5)"


@register("skew_fix", "WITH m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in _SKEW_COLS)
          + " FROM lineitem),\nk AS (SELECT " + ", ".join(f"{_skew_sql(c)} AS k_{c}" for c in _SKEW_COLS)
          + " FROM lineitem, m)\nSELECT l_orderkey, l_linenumber, " + ", ".join(
              f"round(CASE WHEN abs(k_{c}) > 0.75 THEN CASE WHEN {c} >= -1 THEN (pow(1 + {c}, 0.15) - 1) / 0.15 END "
              f"ELSE {c} END, 6) AS {c}" for c in _SKEW_COLS) + " FROM lineitem, k", "J7")
def q_skew_fix(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_SKEW_COLS)
    out, _ = S.skew_fix(li, _SKEW_COLS)
    return out.select("l_orderkey", "l_linenumber", *[r6(c).alias(c) for c in _SKEW_COLS])


@register("cut_width", """
WITH mm AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
e AS (SELECT lo - (hi - lo) * 0.001 AS e0, 1 * ((hi - lo) / 5) + lo AS e1, 2 * ((hi - lo) / 5) + lo AS e2,
             3 * ((hi - lo) / 5) + lo AS e3, 4 * ((hi - lo) / 5) + lo AS e4, hi AS e5 FROM mm)
SELECT o_orderkey, CASE WHEN o_totalprice > e0 THEN CASE WHEN o_totalprice <= e1 THEN 0 WHEN o_totalprice <= e2 THEN 1
  WHEN o_totalprice <= e3 THEN 2 WHEN o_totalprice <= e4 THEN 3 WHEN o_totalprice <= e5 THEN 4 END END AS price_bin
FROM orders, e""", "I2")
def q_cut_width(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    out, _ = B.cut_width(o, "o_totalprice", 5, out="price_bin")
    return out.select("o_orderkey", "price_bin")


_QP = B.quantile_probs(5)


@register("cut_quantile", "WITH q AS (SELECT " + ", ".join(
    f"quantile_cont(o_totalprice, CAST('{p!r}' AS DOUBLE)) AS q{i}" for i, p in enumerate(_QP))
    + " FROM orders)\nSELECT o_orderkey, CASE WHEN o_totalprice = q0 THEN 0 WHEN o_totalprice > q0 THEN CASE "
    + " ".join(f"WHEN o_totalprice <= q{i + 1} THEN {i}" for i in range(5)) + " END END AS price_bin FROM orders, q",
    "I3")
def q_cut_quantile(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    out, _ = B.cut_quantile(o, "o_totalprice", 5, out="price_bin")
    return out.select("o_orderkey", "price_bin")
