"""Tree learners on packed rows: splits and bags by value, fits by floor.

``xgb_split``, ``extra_trees_split`` and ``bag_sizes`` hold the first tree's
splits, the random cuts and the bags to the exact values that SQL computes
from the rows.  The fits are held to what any fit must give (see
``q_models``), at the sizes named in each query.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import boosting as B
from ..operators import forests as FO
from ..operators import trees as T
from .common import r6, vx, with_vitals
from .q_models import CLASS_SQL, FEATS, _SPLIT_SQL, _checked, _regression_checks, split
from .registry import register

# Features with few values, each of them about equally frequent: every value is a bin.
SMALL = ["pband", "age", "rr", "gcs"]
REAL = ["p", "lact", "hemo", "pot"]
L2, MIN_CHILD = 1.0, 1.0
BAGS, TREES, SEED = 5, 4, 42
_BAND = "CAST(floor(p * 40) AS INTEGER)"


def _worth(g, h):
    return f"{g} * {g} / ({h} + {L2})"


def _best_split_sql(name, rows, node):
    """The best split of ``rows`` (id, g, h, features): first-order ties by feature, then value."""
    values = " UNION ALL ".join(f"SELECT {i} AS f, {c} AS v, g, h FROM {rows}" for i, c in enumerate(SMALL))
    return f"""{name}_c AS (SELECT f, v, sum(sum(g)) OVER w AS gl, sum(sum(h)) OVER w AS hl FROM ({values}) GROUP BY f, v
    WINDOW w AS (PARTITION BY f ORDER BY v)),
{name}_s AS (SELECT c.*, t.g - gl AS gr, t.h - hl AS hr,
        0.5 * ({_worth('gl', 'hl')} + {_worth('(t.g - gl)', '(t.h - hl)')} - {_worth('t.g', 't.h')}) AS gain
    FROM {name}_c c, (SELECT sum(g) AS g, sum(h) AS h FROM {rows}) t),
{name} AS (SELECT {node} AS node, f, v, gain, -gl / (hl + {L2}) AS lv, -gr / (hr + {L2}) AS rv FROM {name}_s
    WHERE hl >= {MIN_CHILD} AND hr >= {MIN_CHILD} ORDER BY round(gain, 9) DESC, f, v LIMIT 1)"""


def _side(rows, parent, op):
    x = "CASE b.f " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(SMALL)) + " END"
    return f"{rows} AS (SELECT a.* FROM r0 a, {parent} b WHERE {x} {op} b.v)"


_NAMES = "CASE f " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(SMALL)) + " END"


@register("xgb_split", with_vitals(f""", r0 AS (SELECT {_BAND} AS pband, age, rr, gcs, 0.5 - y AS g, 0.25 AS h FROM vx),
{_best_split_sql('b0', 'r0', 0)}, {_side('r1', 'b0', '<=')}, {_side('r2', 'b0', '>')},
{_best_split_sql('b1', 'r1', 1)}, {_best_split_sql('b2', 'r2', 2)}
SELECT node, {_NAMES} AS feature, CAST(v AS DOUBLE) AS threshold, round(gain, 6) AS gain, round(lv, 6) AS left_value, round(rv, 6) AS right_value
FROM (SELECT * FROM b0 UNION ALL SELECT * FROM b1 UNION ALL SELECT * FROM b2)"""), "N3 N2")
def q_xgb_split(spark, sf_dir):
    """Gains and leaf values of a first tree of depth 2."""
    v = vx(spark, sf_dir).withColumn("pband", F.floor(F.col("p") * 40)).select("id", "y", *SMALL)
    m = B.boost(v, SMALL, "y", rounds=1, rate=0.3, depth=2, start=0.0, l2=L2, min_child=MIN_CHILD)
    rows = [(int(n), f, float(t), float(g), float(a), float(b)) for _, n, f, t, g, a, b in m.history]
    out = spark.createDataFrame(rows, "node int, feature string, threshold double, gain double, left_value double, right_value double")
    return out.withColumns({c: r6(c) for c in ("gain", "left_value", "right_value")})


@register("extra_trees_split", with_vitals(f""", x AS (SELECT y, unnest([{', '.join(f"'{c}'" for c in REAL)}]) AS feature,
    unnest([{', '.join(str(i) for i in range(len(REAL)))}]) AS f, unnest([{', '.join(f'CAST({c} AS DOUBLE)' for c in REAL)}]) AS v FROM vx),
e AS (SELECT feature, f, min(v) AS lo, max(v) AS hi FROM x GROUP BY ALL),
c AS (SELECT t, feature, f, lo + CAST('0x' || substr(md5('{SEED}:' || t || ':0:' || f), 1, 8) AS BIGINT) / 4294967296.0 * (hi - lo) AS cut
    FROM e, (SELECT unnest(range({TREES})) AS t)),
s AS (SELECT t, c.feature, c.f, cut, count_if(v IS NULL OR v <= cut) AS nl, sum(y) FILTER (v IS NULL OR v <= cut) AS sl, count(*) AS n, sum(y) AS s
    FROM x JOIN c USING (f) GROUP BY ALL),
g AS (SELECT *, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n AS gain FROM s WHERE nl > 0 AND nl < n)
SELECT CAST(t AS INTEGER) AS tree, feature, round(cut, 6) AS cut, round(gain, 6) AS gain, round(sl / nl, 6) AS left_value, round((s - sl) / (n - nl), 6) AS right_value
FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY gain DESC, f) AS k FROM g) WHERE k = 1"""), "N6")
def q_extra_trees_split(spark, sf_dir):
    """The random cuts of trees of depth 1 over all candidates."""
    v = vx(spark, sf_dir).select("y", *[F.col(c).cast("double").alias(c) for c in REAL])
    m = FO.extra_trees(v, REAL, "y", trees=TREES, depth=1, candidates=len(REAL), seed=SEED)
    rows = [(i, REAL[t[0][0]], float(t[2][0]), float(m.root_gains[i]), float(t[5][t[3][0]]), float(t[5][t[4][0]])) for i, t in enumerate(m.trees)]
    out = spark.createDataFrame(rows, "tree int, feature string, cut double, gain double, left_value double, right_value double")
    return out.withColumns({c: r6(c) for c in ("cut", "gain", "left_value", "right_value")})


@register("bag_sizes", with_vitals(f""", n AS (SELECT y, count(*) AS n FROM vx GROUP BY y)
SELECT CAST(unnest(range({BAGS})) AS INTEGER) AS bag, y, (SELECT min(n) FROM n) AS n_rows FROM n"""), "L7 N12")
def q_bag_sizes(spark, sf_dir):
    """Rows of each class in each bag of the balanced forest."""
    v = vx(spark, sf_dir).select("id", "y", "p")
    edges = T.edges_of(v, ["p"], 63)
    packed = T.pack(v, ["p"], "y", edges, "id")
    sizes = {float(r[0]): r[1] for r in v.groupBy("y").count().collect()}
    most = FO.bag_thresholds(packed, sizes, BAGS, SEED, 1)

    def count(batches):
        total = np.zeros((BAGS, len(most)))
        for c in T.chunks_of(batches, 1):
            for i, (k, limit) in enumerate(sorted(most.items())):
                for b in range(BAGS):
                    total[b, i] += (T.draw(c.u[c.y == k], SEED + b) <= limit[b]).sum()
        return total

    got = packed.summed(count).reshape(BAGS, len(most))
    rows = [(b, int(k), int(got[b, i])) for b in range(BAGS) for i, k in enumerate(sorted(most))]
    return spark.createDataFrame(rows, "bag int, y int, n_rows long")


@register("xgb_fit", CLASS_SQL, "N3")
def q_xgb_fit(spark, sf_dir):
    """60 trees of depth 4 with L1, L2, gamma, row and column draws."""
    tr, te = split(spark, sf_dir)
    m = B.boost(tr, FEATS, "y", rounds=60, rate=0.1, depth=4, l1=0.005, l2=1.0, gamma=0.1, min_child=2.0, subsample=0.8, columns=0.8, key="id", start=0.0)
    return _checked(m.predict(te, "prob"), "prob")


@register("lgbm_fit", CLASS_SQL, "N3")
def q_lgbm_fit(spark, sf_dir):
    """40 trees of 5 leaves, best leaf first."""
    tr, te = split(spark, sf_dir)
    m = B.boost(tr, FEATS, "y", rounds=40, rate=0.1, leaves=5, subsample=0.8, columns=0.8, key="id", min_rows=11)
    return _checked(m.predict(te, "prob"), "prob")


@register("huber_gbt_fit", with_vitals(_SPLIT_SQL + "SELECT id, TRUE AS huber_ok FROM test"), "N2")
def q_huber_gbt_fit(spark, sf_dir):
    """12 trees of depth 4 under Huber loss, leaves from medians."""
    tr, te = split(spark, sf_dir)
    m = B.boost(tr, FEATS, "p", loss="huber", rounds=12, rate=0.3, depth=4, min_rows=15)
    return _regression_checks(m.predict(te, "huber"), ["huber"])
