"""Nearest-neighbour queries: kNN join, kNN vote, kNN imputation, SMOTE and
ADASYN.  Oracles are brute-force SQL over all pairs (fine at the
correctness scale; the Spark plans never build the pair table)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighbors as NB
from ..operators import rebalance as RB
from .common import r6, t, vx, with_vitals
from .registry import register

DIM = 64
_E = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


def _sq(a, b):
    return f"list_sum(list_transform(range(1, {DIM + 1}), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


def _knn_sql(left, right, k):
    return (f"SELECT a.vec_id AS q, b.vec_id AS x, round({_sq('a.v', 'b.v')}, 6) AS d FROM {left} a "
            f"JOIN {right} b ON a.vec_id <> b.vec_id")


def emb(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


@register("knn_join", f"""WITH {_E},
p AS ({_knn_sql('e', 'e', 5)}),
r AS (SELECT q, x, d, row_number() OVER (PARTITION BY q ORDER BY d, x) AS rk FROM p)
SELECT q AS vec_id, x AS neighbor_id, CAST(rk AS INTEGER) AS rank, d AS sq_dist FROM r WHERE rk <= 5""", "C3")
def q_knn_join(spark, sf_dir):
    e = emb(spark, sf_dir)
    nb = NB.knn(e, e, 5, "vec_id", "v", "vec_id", "v", exclude_self=True)
    return nb.select(F.col("q_key").alias("vec_id"), F.col("nb_key").alias("neighbor_id"), "rank", "sq_dist")


@register("knn_classify", f"""WITH {_E},
p AS ({_knn_sql('e', 'e', 5)}),
r AS (SELECT q, x, d, row_number() OVER (PARTITION BY q ORDER BY d, x) AS rk FROM p),
t AS (SELECT r.q, e.label AS l, count(*) AS n, sum(CASE WHEN sqrt(d) > 0 THEN 1.0 / sqrt(d) ELSE 0.0 END) AS w,
             count_if(d = 0) AS z
      FROM r JOIN e ON r.x = e.vec_id WHERE rk <= 5 GROUP BY r.q, e.label),
u AS (SELECT q, l, row_number() OVER (PARTITION BY q ORDER BY n DESC, l) AS ru,
             row_number() OVER (PARTITION BY q ORDER BY z DESC, w DESC, l) AS rw FROM t)
SELECT a.q AS vec_id, a.l AS pred_uniform, b.l AS pred_distance
FROM u a JOIN u b ON a.q = b.q AND a.ru = 1 AND b.rw = 1""", "N9 C3")
def q_knn_classify(spark, sf_dir):
    return NB.knn_classify(emb(spark, sf_dir), "vec_id", "v", "label", k=5)


_IMP_COLS = ["temp", "sc", "bmi", "age", "hr"]


def _nan_sq(a, b):
    return " + ".join(f"CASE WHEN {a}.{c} IS NOT NULL AND {b}.{c} IS NOT NULL THEN "
                      f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c}) ELSE 0 END" for c in _IMP_COLS)


def _nan_n(a, b):
    return " + ".join(f"CASE WHEN {a}.{c} IS NOT NULL AND {b}.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in _IMP_COLS)


def _impute_col_sql(c):
    return f"""f_{c} AS (
  SELECT rk, avg(val) AS fill FROM (
    SELECT a.id AS rk, b.{c} AS val, row_number() OVER (PARTITION BY a.id ORDER BY
        round(sqrt(({_nan_sq('a', 'b')}) * {len(_IMP_COLS)}.0 / ({_nan_n('a', 'b')})), 6), b.id) AS r
    FROM w a JOIN w b ON a.{c} IS NULL AND b.{c} IS NOT NULL AND ({_nan_n('a', 'b')}) > 0) s
  WHERE r <= 5 GROUP BY rk)"""


@register("knn_impute", with_vitals(
    ", w AS (SELECT id, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _IMP_COLS) + " FROM vx),\n"
    "m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in _IMP_COLS) + " FROM w),\n"
    + ",\n".join(_impute_col_sql(c) for c in ["temp", "sc", "bmi"])
    + "\nSELECT w.id AS id, " + ", ".join(
        f"round(coalesce(w.{c}, f_{c}.fill, m.m_{c}), 6) AS {c}" for c in ["temp", "sc", "bmi"])
    + " FROM w CROSS JOIN m " + " ".join(f"LEFT JOIN f_{c} ON w.id = f_{c}.rk" for c in ["temp", "sc", "bmi"])),
    "K7 C4")
def q_knn_impute(spark, sf_dir):
    v = vx(spark, sf_dir).select("id", *[F.col(c).cast("double").alias(c) for c in _IMP_COLS])
    out = NB.knn_impute(v, "id", _IMP_COLS, k=5)
    return out.select("id", *[r6(c).alias(c) for c in ["temp", "sc", "bmi"]])


def _smote_sql(copies_cte: str) -> str:
    return f"""WITH {_E},
m AS (SELECT * FROM e WHERE label = 0),
cnt AS (SELECT count_if(label = 0) AS n_min, count_if(label <> 0) AS n_maj FROM e),
p AS ({_knn_sql('m', 'm', 5)}),
rk AS (SELECT q, x, row_number() OVER (PARTITION BY q ORDER BY d, x) AS r FROM p),
nn AS (SELECT q, count(*) AS n_nb FROM rk WHERE r <= 5 GROUP BY q),
{copies_cte},
cp AS (SELECT vec_id, unnest(range(n_copies)) AS c FROM copies WHERE n_copies > 0),
g AS (SELECT cp.vec_id AS src_id, cp.c AS copy, rk.x AS nb_id,
             CAST((cp.vec_id * 13 + cp.c * 31) % 1000 AS DOUBLE) / 1000 AS u
      FROM cp JOIN nn ON nn.q = cp.vec_id
      JOIN rk ON rk.q = cp.vec_id AND rk.r = 1 + (cp.vec_id * 7 + cp.c) % least(5, nn.n_nb))
SELECT g.src_id, CAST(g.copy AS INTEGER) AS copy, g.nb_id, g.u,
       round(a.v[1] + g.u * (b.v[1] - a.v[1]), 6) AS x0, round(a.v[2] + g.u * (b.v[2] - a.v[2]), 6) AS x1,
       round(list_sum(list_transform(range(1, {DIM + 1}), lambda i: a.v[i] + g.u * (b.v[i] - a.v[i]))), 6) AS vsum,
       0 AS label
FROM g JOIN m a ON a.vec_id = g.src_id JOIN m b ON b.vec_id = g.nb_id
UNION ALL SELECT vec_id, NULL, NULL, NULL, round(v[1], 6), round(v[2], 6), round(list_sum(v), 6), label FROM e"""


def _synthetic_out(df):
    return df.select("src_id", F.col("copy").cast("int").alias("copy"), "nb_id", "u",
                     r6(F.col("v")[0]).alias("x0"), r6(F.col("v")[1]).alias("x1"),
                     r6(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x)).alias("vsum"), "label")


@register("smote", _smote_sql("""copies AS (
  SELECT vec_id, CAST((n_new // n_min) + CASE WHEN pos < n_new % n_min THEN 1 ELSE 0 END AS BIGINT) AS n_copies
  FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM m) s,
       (SELECT CAST(floor(0.3 * n_maj) AS BIGINT) - n_min AS n_new, n_min FROM cnt) k)"""), "L4")
def q_smote(spark, sf_dir):
    s = RB.smote(emb(spark, sf_dir), "vec_id", "v", "label", minority=0, ratio=0.3, k=5)
    return _synthetic_out(s)


@register("adasyn", _smote_sql("""pa AS (SELECT a.vec_id AS q, b.vec_id AS x, b.label AS bl,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY round(""" + _sq('a.v', 'b.v') + """, 6), b.vec_id) AS r
      FROM m a JOIN e b ON a.vec_id <> b.vec_id),
hard AS (SELECT q, count_if(bl <> 0) / 5.0 AS ri FROM pa WHERE r <= 5 GROUP BY q),
tot AS (SELECT sum(ri) AS s FROM hard),
copies AS (SELECT q AS vec_id, CAST(round_even(ri / s * (CAST(floor(0.8 * n_maj) AS BIGINT) - n_min), 0) AS BIGINT) AS n_copies
           FROM hard, tot, cnt)"""), "L5")
def q_adasyn(spark, sf_dir):
    s = RB.adasyn(emb(spark, sf_dir), "vec_id", "v", "label", minority=0, ratio=0.8, k=5)
    return _synthetic_out(s)
