"""Cross-validation of linear models from per-fold sums, by value."""

from __future__ import annotations

from ..operators import linear as LI
from ..operators import sampling as SA
from .common import r6, vx, with_vitals
from .registry import register

PAIR = ["lact", "hemo"]
RIDGES = [0.0, 10.0, 1000.0]


@register("cv_linear", with_vitals(f""", f AS (SELECT id, y, p, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in PAIR)},
    (row_number() OVER (PARTITION BY y ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id) - 1) % 5 AS fold FROM vx),
k AS (SELECT unnest(range(5)) AS k),
m AS (SELECT k, avg(lact) AS ma, avg(hemo) AS mb, avg(p) AS my, stddev_pop(lact) AS sa, stddev_pop(hemo) AS sb FROM f, k WHERE fold <> k GROUP BY k),
s AS (SELECT k, sum((lact - ma) / sa * ((lact - ma) / sa)) AS aa, sum((hemo - mb) / sb * ((hemo - mb) / sb)) AS bb,
        sum((lact - ma) / sa * ((hemo - mb) / sb)) AS ab, sum((lact - ma) / sa * (p - my)) AS ay, sum((hemo - mb) / sb * (p - my)) AS byy
    FROM f JOIN m ON fold <> k GROUP BY k),
r AS (SELECT unnest([{', '.join(map(str, RIDGES))}]) AS ridge),
c AS (SELECT k, ridge, ((bb + ridge) * ay - ab * byy) / ((aa + ridge) * (bb + ridge) - ab * ab) AS ca,
        ((aa + ridge) * byy - ab * ay) / ((aa + ridge) * (bb + ridge) - ab * ab) AS cb FROM s, r)
SELECT CAST(ridge AS DOUBLE) AS ridge, CAST(c.k AS INTEGER) AS fold, round(sqrt(avg((my + ca * (lact - ma) / sa + cb * (hemo - mb) / sb - p)
    * (my + ca * (lact - ma) / sa + cb * (hemo - mb) / sb - p))), 6) AS rmse
FROM c JOIN m USING (k) JOIN f ON f.fold = c.k GROUP BY ridge, c.k"""), "N15 N5 D19 L2")
def q_cv_linear(spark, sf_dir):
    """Held-out error of each fold and ridge penalty, one scan."""
    v = vx(spark, sf_dir).select("id", "y", "p", *PAIR)
    folded = SA.strat_kfold(v, "id", "y", k=5)
    rows = LI.cross_validate_linear(folded, PAIR, "p", "fold", [(r, 0.0) for r in RIDGES])
    out = spark.createDataFrame([(float(r), int(f), e) for r, _, f, e in rows], "ridge double, fold int, rmse double")
    return out.withColumn("rmse", r6("rmse"))
