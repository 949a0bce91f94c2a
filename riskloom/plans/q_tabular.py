"""Projections, filters, set operations, string and math functions, and
profiles over the TPC-H-like driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import profile as P
from ..operators.ordering import ordered_index
from ..operators.setops import union_tagged
from ..session import ensure_checkpoint_dir
from ..sources import read_csv, read_headerless
from ..sources.sinks import write_csv
from .common import r6, t
from .registry import register

# Induced missing values (the driver tables hold none): the same rule in
# both engines.
CN_SQL = ("cn AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment, "
          "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, "
          "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer)")
LN_SQL = ("ln AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_shipdate, "
          "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS price FROM lineitem)")


def customer_nulls(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    return c.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment",
                    F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal")).alias("c_acctbal"),
                    F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("segment"))


def lineitem_nulls(spark, sf_dir, rows="true"):
    li = t(spark, sf_dir, "lineitem").where(rows)
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
                     "l_returnflag", "l_shipdate",
                     F.when(F.col("l_orderkey") % 11 != 0, F.col("l_extendedprice")).alias("price"))


@register("scan_project", """
SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS INTEGER) AS qty, l_extendedprice,
       CAST(l_linenumber AS VARCHAR) AS line_text, l_returnflag
FROM lineitem""", "A1 B1 B2 B17")
def q_scan_project(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    out = li.withColumn("qty", F.col("l_quantity").cast("int")) \
            .withColumn("line_text", F.col("l_linenumber").cast("string"))
    return (out.drop("l_partkey", "l_suppkey", "l_discount", "l_tax", "l_linestatus",
                     "l_shipdate", "l_quantity", "no_such_column")
            .select("l_orderkey", "l_linenumber", "qty", "l_extendedprice", "line_text", "l_returnflag"))


def _csv_folder(spark):
    return f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex[:12]}"


@register("csv_sink_scan", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer", "A1 A4")
def q_csv_sink_scan(spark, sf_dir):
    path = _csv_folder(spark)
    write_csv(t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    return read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string")


@register("csv_group_sink", """SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 6) AS total FROM customer GROUP BY c_mktsegment""", "A1 A5")
def q_csv_group_sink(spark, sf_dir):
    path = _csv_folder(spark)
    write_csv(t(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("total")), path)
    back = read_csv(spark, path)  # types inferred from the text
    return back.select("c_mktsegment", F.col("n").cast("long").alias("n"), F.round("total", 6).alias("total"))


@register("headerless_scan", "SELECT o_orderkey AS k, o_orderpriority AS name, o_custkey AS customer FROM orders", "A2")
def q_headerless_scan(spark, sf_dir):
    path = _csv_folder(spark)
    t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey").write.csv(path)
    return read_headerless(spark, path, "k long, name string, customer long")


@register("outlier_drop", f"""WITH {LN_SQL}
SELECT l_orderkey, l_linenumber, price FROM ln
WHERE NOT coalesce(l_quantity > 45 AND price < 20000, false)""", "B3")
def q_outlier_drop(spark, sf_dir):
    ln = lineitem_nulls(spark, sf_dir)
    rule = (F.col("l_quantity") > 45) & (F.col("price") < 20000)
    return ln.where(~F.coalesce(rule, F.lit(False))).select("l_orderkey", "l_linenumber", "price")


@register("outlier_keep", f"""WITH {LN_SQL}
SELECT l_orderkey, l_linenumber, price FROM ln WHERE price > 20000""", "B4")
def q_outlier_keep(spark, sf_dir):
    # A kept price is the stored one, so the bound also filters the scan.
    ln = lineitem_nulls(spark, sf_dir, "l_extendedprice > 20000")
    return ln.where(F.col("price") > 20000).select("l_orderkey", "l_linenumber", "price")


@register("union_tagged", """
SELECT c_custkey AS key, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment, 'train' AS _split FROM customer
UNION ALL
SELECT s_suppkey AS key, s_name AS name, s_acctbal AS acctbal, CAST(NULL AS VARCHAR) AS segment, 'test' AS _split FROM supplier
""", "G1 B5")
def q_union_tagged(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    s = t(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("acctbal"))
    return union_tagged(c, s)


@register("derived_arith", """
SELECT l_orderkey, l_linenumber,
  l_extendedprice * (1 - l_discount) AS revenue,
  l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge,
  l_extendedprice / (l_quantity + 1) AS per_unit,
  CAST(1998 - year(l_shipdate) AS INTEGER) AS years_since_ship,
  CAST(l_quantity + l_linenumber + 1 AS DOUBLE) AS family_size
FROM lineitem""", "B6 H16")
def q_derived_arith(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    c = F.col
    return li.select(
        "l_orderkey", "l_linenumber",
        (c("l_extendedprice") * (1 - c("l_discount"))).alias("revenue"),
        (c("l_extendedprice") * (1 - c("l_discount")) * (1 + c("l_tax"))).alias("charge"),
        (c("l_extendedprice") / (c("l_quantity") + 1)).alias("per_unit"),
        (F.lit(1998) - F.year("l_shipdate")).cast("int").alias("years_since_ship"),
        (c("l_quantity") + c("l_linenumber") + 1).cast("double").alias("family_size"))


@register("row_sum", f"""WITH {LN_SQL}
SELECT l_orderkey, l_linenumber,
  coalesce(price, 0) + coalesce(l_quantity, 0) + coalesce(l_tax, 0) AS total_nulls_zero,
  price + l_quantity + l_tax AS total_plain
FROM ln""", "B7")
def q_row_sum(spark, sf_dir):
    ln = lineitem_nulls(spark, sf_dir)
    cols = ["price", "l_quantity", "l_tax"]
    return ln.select("l_orderkey", "l_linenumber", C.row_sum(cols).alias("total_nulls_zero"),
                     (F.col("price") + F.col("l_quantity") + F.col("l_tax")).alias("total_plain"))


@register("clip", f"""WITH {LN_SQL}
SELECT l_orderkey, l_linenumber,
  CASE WHEN price IS NOT NULL THEN least(greatest(price, 5000.0), 50000.0) END AS price_clipped
FROM ln""", "B16")
def q_clip(spark, sf_dir):
    ln = lineitem_nulls(spark, sf_dir)
    return ln.select("l_orderkey", "l_linenumber", C.clip("price", 5000.0, 50000.0).alias("price_clipped"))


@register("math_transforms", """
SELECT l_orderkey, l_linenumber,
  round(ln(1 + l_extendedprice), 6) AS log_price,
  round(exp(l_discount) - 1, 6) AS expm1_discount,
  round(pow(l_quantity, 2), 6) AS qty_sq,
  round(sqrt(abs(l_extendedprice - 30000)), 6) AS sqrt_dev
FROM lineitem""", "H10 H11")
def q_math_transforms(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    c = F.col
    return li.select("l_orderkey", "l_linenumber", r6(F.log1p("l_extendedprice")).alias("log_price"),
                     r6(F.expm1("l_discount")).alias("expm1_discount"),
                     r6(F.pow(c("l_quantity"), 2)).alias("qty_sq"),
                     r6(F.sqrt(F.abs(c("l_extendedprice") - 30000))).alias("sqrt_dev"))


@register("boxcox", """
SELECT l_orderkey, l_linenumber,
  round((pow(1 + l_extendedprice / 1000, 0.15) - 1) / 0.15, 6) AS price_bc,
  round(ln(1 + l_discount), 6) AS discount_bc0,
  CASE WHEN l_discount - 1.05 >= -1 THEN round((pow(1 + (l_discount - 1.05), 0.15) - 1) / 0.15, 6) END AS shifted_bc
FROM lineitem""", "H12")
def q_boxcox(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     r6(C.boxcox1p(F.col("l_extendedprice") / 1000, 0.15)).alias("price_bc"),
                     r6(C.boxcox1p("l_discount", 0)).alias("discount_bc0"),
                     r6(C.boxcox1p(F.col("l_discount") - 1.05, 0.15)).alias("shifted_bc"))


# Ordinal scale used by the dict_map query.
PRIORITY_SCALE = {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3}


@register("dict_map", """
SELECT o_orderkey, coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4
       WHEN '3-MEDIUM' THEN 3 END, 0) AS priority_code FROM orders""", "B13")
def q_dict_map(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    return o.select("o_orderkey", C.dict_map("o_orderpriority", PRIORITY_SCALE, 0).alias("priority_code"))


TYPE_RENAME = {"ECONOMY": "Economy", "SMALL": "Small"}


@register("dict_replace", """
SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'Economy' WHEN 'SMALL' THEN 'Small' ELSE p_type END AS p_type
FROM part""", "B14 B20")
def q_dict_replace(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    return p.select("p_partkey", C.dict_replace("p_type", TYPE_RENAME).alias("p_type"))


@register("sentinel_null", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN l_discount END AS discount
FROM lineitem""", "B15")
def q_sentinel_null(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", C.sentinel_null("l_discount", 0.0).alias("discount"))


@register("seq_id", """
SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS seq FROM orders""", "B19")
def q_seq_id(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey")
    out = ordered_index(o, ["o_orderkey"], name="rn")
    return out.select("o_orderkey", (F.col("rn") - 1).alias("seq"))


@register("str_extract", """
SELECT page_id, nullif(regexp_extract(url, '://([A-Za-z.]+)\\.example', 1), '') AS host_prefix,
       nullif(regexp_extract(url, ' ([A-Za-z]+)\\.', 1), '') AS title
FROM pages""", "H1")
def q_str_extract(spark, sf_dir):
    pg = t(spark, sf_dir, "pages")
    return pg.select("page_id", C.first_group("url", r"://([A-Za-z.]+)\.example").alias("host_prefix"),
                     C.first_group("url", r" ([A-Za-z]+)\.").alias("title"))


@register("str_tokens", """
SELECT c_custkey,
  split_part(c_name, '#', 1) AS prefix,
  coalesce(TRY_CAST(split_part(c_name, '#', 2) AS DOUBLE), 0.0) AS number,
  coalesce(TRY_CAST(c_mktsegment AS DOUBLE), 0.0) AS bad_number,
  string_split_regex(trim(c_mktsegment || ' ' || c_name), '\\s+')[-1] AS last_token,
  coalesce(substring(c_mktsegment, 1, 1), 'U') AS first_char,
  CAST(coalesce(len(string_split_regex(trim(c_mktsegment || ' x ' || c_name), '\\s+')), 0) AS INTEGER) AS n_tokens,
  CAST(length(c_name) AS INTEGER) AS name_len,
  contains(c_mktsegment, 'MACH') AS has_mach
FROM customer""", "H2 H3 H4 H5 H6 H7 H8")
def q_str_tokens(spark, sf_dir):
    cu = t(spark, sf_dir, "customer")
    c = F.col
    return cu.select(
        "c_custkey",
        C.first_token("c_name", "#").alias("prefix"),
        C.to_number(F.split_part(c("c_name"), F.lit("#"), F.lit(2)), 0.0).alias("number"),
        C.to_number("c_mktsegment", 0.0).alias("bad_number"),
        C.last_token(F.concat_ws(" ", c("c_mktsegment"), c("c_name"))).alias("last_token"),
        C.first_char("c_mktsegment").alias("first_char"),
        C.token_count(F.concat_ws(" x ", c("c_mktsegment"), c("c_name"))).alias("n_tokens"),
        F.length("c_name").alias("name_len"),
        c("c_mktsegment").contains("MACH").alias("has_mach"))


@register("composite_key", """
SELECT p_partkey, concat_ws('_', p_brand, CAST(p_size AS VARCHAR)) AS brand_size FROM part""", "H9")
def q_composite_key(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    return p.select("p_partkey", C.composite_key("p_brand", "p_size").alias("brand_size"))


@register("shape", """
SELECT CAST(count(*) AS BIGINT) AS n_rows, 11 AS n_cols FROM lineitem""", "D22")
def q_shape(spark, sf_dir):
    return P.shape(t(spark, sf_dir, "lineitem"))


@register("output_summary", """
SELECT min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice), 6) AS mean,
       median(l_extendedprice) AS median FROM lineitem""", "D10")
def q_output_summary(spark, sf_dir):
    s = P.output_summary(t(spark, sf_dir, "lineitem"), "l_extendedprice")
    return s.withColumn("mean", r6("mean"))


@register("topk", """
SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey ASC LIMIT 10""", "F1 F3")
def q_topk(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    return P.top_k(p, "p_retailprice", 10, "p_partkey")


@register("value_counts", """
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderpriority IS NOT NULL
GROUP BY o_orderpriority""", "D1")
def q_value_counts(spark, sf_dir):
    return P.value_counts(t(spark, sf_dir, "orders"), "o_orderpriority")


@register("prevalence", """
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count_if(quality = 1) AS BIGINT) AS positives,
       CAST(count_if(quality = 0) AS BIGINT) AS negatives,
       round(100.0 * count_if(quality = 1) / count(*), 6) AS positive_pct,
       CAST(floor(count_if(quality = 0) / count_if(quality = 1)) AS BIGINT) AS imbalance_ratio
FROM labels""", "D2")
def q_prevalence(spark, sf_dir):
    p = P.prevalence(t(spark, sf_dir, "labels"), "quality")
    return p.withColumn("positive_pct", r6("positive_pct"))


@register("null_profile", f"""WITH {CN_SQL},
s AS (SELECT count(*) AS n, count(c_custkey) AS a, count(c_name) AS b, count(c_nationkey) AS c,
             count(c_mktsegment) AS d, count(c_acctbal) AS e, count(segment) AS f FROM cn),
u AS (SELECT 'c_custkey' AS column_name, 'bigint' AS dtype, a AS non_null, n FROM s UNION ALL
      SELECT 'c_name', 'string', b, n FROM s UNION ALL SELECT 'c_nationkey', 'int', c, n FROM s UNION ALL
      SELECT 'c_mktsegment', 'string', d, n FROM s UNION ALL SELECT 'c_acctbal', 'double', e, n FROM s UNION ALL
      SELECT 'segment', 'string', f, n FROM s)
SELECT column_name, dtype, CAST(non_null AS BIGINT) AS non_null, CAST(n - non_null AS BIGINT) AS missing,
       round(100.0 * (n - non_null) / n, 2) AS missing_pct
FROM u WHERE n - non_null > 0""", "D12 D23 B22 H15 F2")
def q_null_profile(spark, sf_dir):
    return P.null_profile(customer_nulls(spark, sf_dir)).orderBy(F.col("missing").desc(), "column_name")


_DESC_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def _describe_sql(by: str | None) -> str:
    parts = []
    for c in _DESC_COLS:
        sel = (f"SELECT {by + ', ' if by else ''}'{c}' AS column_name, CAST(count({c}) AS BIGINT) AS count, "
               f"round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, "
               f"round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, "
               f"round(quantile_cont({c}, 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM lineitem"
               + (f" GROUP BY {by}" if by else ""))
        parts.append(sel)
    return "\nUNION ALL\n".join(parts)


def _round_describe(df):
    return df.select(*[r6(c).alias(c) if c in ("mean", "std", "q25", "q50", "q75") else F.col(c)
                       for c in df.columns])


@register("describe", _describe_sql(None), "D7")
def q_describe(spark, sf_dir):
    return _round_describe(P.describe(t(spark, sf_dir, "lineitem"), _DESC_COLS))


@register("describe_grouped", _describe_sql("l_returnflag"), "D7")
def q_describe_grouped(spark, sf_dir):
    return _round_describe(P.describe(t(spark, sf_dir, "lineitem"), _DESC_COLS, by=["l_returnflag"]))


@register("distinct_levels", "SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL", "D8")
def q_distinct_levels(spark, sf_dir):
    return P.distinct_levels(t(spark, sf_dir, "part"), "p_type")


_SKEW_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("skew_profile", "WITH m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in _SKEW_COLS)
          + " FROM lineitem)\n" + "\nUNION ALL\n".join(
              f"SELECT '{c}' AS column_name, round(avg(pow({c} - m_{c}, 3)) / pow(avg(pow({c} - m_{c}, 2)), 1.5), 6) AS skew, "
              f"CASE WHEN abs(avg(pow({c} - m_{c}, 3)) / pow(avg(pow({c} - m_{c}, 2)), 1.5)) > 0.75 THEN 1 ELSE 0 END AS skewed "
              f"FROM lineitem, m" for c in _SKEW_COLS), "D9")
def q_skew_profile(spark, sf_dir):
    s = P.skew_profile(t(spark, sf_dir, "lineitem"), _SKEW_COLS)
    return s.withColumn("skew", r6("skew"))
