"""DTW queries (D1-D6): pair distances, paths, group medoids."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.random import sql_uniform
from ..operators import dtw as D
from ..sources.tables import samples
from .registry import register

W = 7  # ceil(64 / 10): the 10 % band used by the reference's callers


# ---- the same in SQL: the dynamic program as a recursion over anti-diagonals (or rows) ----

_ORDERED = f"""e AS (SELECT vec_id AS sample_id, label, embedding::DOUBLE[] AS a FROM embeddings),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql_uniform(0, "'order'", "sample_id")}, sample_id) - 1 AS pos,
  count(*) OVER (PARTITION BY label) AS m FROM e)"""
PAIRS_SQL = _ORDERED + """,
pairs AS (SELECT x.sample_id AS pid, x.sample_id, y.sample_id AS partner_id, x.a AS a, y.a AS b
  FROM o AS x JOIN o AS y ON y.label = x.label AND y.pos = (x.pos + 1) % x.m WHERE x.m > 1)"""


def cells_sql(cost: str, band: str) -> str:
    """Cells (1-based i, j) of every pair within ``band``, with their ``cost`` (of lists a, b)."""
    return f"""cells AS MATERIALIZED (SELECT pid, i, j, {cost} AS c
  FROM (SELECT pid, a, b, unnest(range(1, len(a) + 1)) AS i FROM pairs) AS r, (SELECT unnest(range(1, 65)) AS j) AS q
  WHERE j <= len(b) AND {band})"""


def symmetric_sql(weight: float = 1.0) -> str:
    """dp: the accumulated cost v of every cell.  A step takes the last two diagonals (age 0 and 1) to the next."""
    return f"""dp AS (
  SELECT pid, 0::BIGINT AS d, 0::BIGINT AS i, 0::DOUBLE AS v, 0 AS age FROM pairs
  UNION ALL
  SELECT * FROM (
    SELECT n.pid, n.d, n.i, min(n.v) + any_value(c.c) AS v, 0 AS age
    FROM (SELECT pid, d + 1 AS d, i + k AS i, v * {weight} AS v FROM dp, (VALUES (0), (1)) AS t(k) WHERE age = 0
          UNION ALL SELECT pid, d + 2, i + 1, v FROM dp WHERE age = 1) AS n
    JOIN cells AS c ON c.pid = n.pid AND c.i = n.i AND c.j = n.d - n.i GROUP BY n.pid, n.d, n.i
    UNION ALL SELECT pid, d, i, v, 1 FROM dp WHERE age = 0) AS step)"""


ASYMMETRIC_SQL = """dp AS (
  SELECT pid, 0::BIGINT AS i, 0::BIGINT AS j, 0::DOUBLE AS v FROM pairs
  UNION ALL
  SELECT * FROM (SELECT c.pid, c.i, c.j, min(dp.v) + any_value(c.c) AS v
    FROM dp, (VALUES (0), (1), (2)) AS t(k), cells AS c
    WHERE c.pid = dp.pid AND c.i = dp.i + 1 AND c.j = dp.j + k GROUP BY c.pid, c.i, c.j) AS step)"""

# steps back from the last cell; of equal costs the diagonal first, then up, then left
PATH_SQL = """full_ AS MATERIALIZED (SELECT pid, i, d - i AS j, v FROM dp WHERE age = 0),
back AS (
  SELECT pid, len(a)::BIGINT AS i, len(b)::BIGINT AS j, 0 AS n FROM pairs
  UNION ALL
  SELECT * FROM (SELECT back.pid, arg_min(f.i, {'v': f.v, 'k': k}) AS i, arg_min(f.j, {'v': f.v, 'k': k}) AS j, any_value(n) + 1 AS n
    FROM back, (VALUES (1, 1, 0), (1, 0, 1), (0, 1, 2)) AS t(di, dj, k), full_ AS f
    WHERE back.i + back.j > 2 AND f.pid = back.pid AND f.i = back.i - di AND f.j = back.j - dj GROUP BY back.pid) AS step),
path AS (SELECT pid, max(n) OVER (PARTITION BY pid) - n AS step, i - 1 AS i, j - 1 AS j FROM back)"""

_BAND = f"abs(i - j) <= {W}"
_LINE = "abs(a[i] - b[j])"
_LAST = """ SELECT sample_id, partner_id, v AS dist FROM dp JOIN pairs USING (pid)
WHERE age = 0 AND i = len(a) AND d = len(a) + len(b)"""
# windows of 5 steps around each step, ends repeated (5 % of 64 steps, 5 at least)
_SHAPE = "sqrt(" + " + ".join(f"power(a[least(greatest(i + {k}, 1), 64)] - b[least(greatest(j + {k}, 1), 64)], 2)" for k in range(-3, 2)) + ")"


def distance_sql(cost: str = _LINE, band: str = _BAND, weight: float = 1.0) -> str:
    return f"WITH RECURSIVE {PAIRS_SQL}, {cells_sql(cost, band)}, {symmetric_sql(weight)}" + _LAST


def _pairs(spark, sf_dir):
    return D.class_partners(samples(spark, sf_dir), seed=0, offsets=(1,))


@register("d1_dtw_symmetric", distance_sql(), dbl=["dist"])
def q_d1(spark, sf_dir):
    """D1 symmetric-step DTW (10 % band) of each sample and a same-class partner."""
    p = _pairs(spark, sf_dir)
    return p.select("sample_id", "partner_id", D.dtw_distance("symmetric", W)(F.col("series"),
                                                                           F.col("partner_series")).alias("dist"))


@register("d1_dtw_asymmetric", f"WITH RECURSIVE {PAIRS_SQL}, {cells_sql(_LINE, _BAND)}, {ASYMMETRIC_SQL}" + """
SELECT sample_id, partner_id, v AS dist FROM dp JOIN pairs USING (pid) WHERE i = len(a) AND j = len(b)""", dbl=["dist"])
def q_d1b(spark, sf_dir):
    """D1 asymmetric-step DTW of the same pairs."""
    p = _pairs(spark, sf_dir)
    return p.select("sample_id", "partner_id", D.dtw_distance("asymmetric", W)(F.col("series"),
                                                                            F.col("partner_series")).alias("dist"))


@register("d2_shape_dtw", distance_sql(_SHAPE, f"j - i BETWEEN -{W} AND {W - 1}"), dbl=["dist"])
def q_d2(spark, sf_dir):
    """D2 shape-DTW of the same pairs."""
    p = _pairs(spark, sf_dir)
    return p.select("sample_id", "partner_id", D.dtw_distance("symmetric", W, shape=True)(
        F.col("series"), F.col("partner_series")).alias("dist"))


@register("d3_warping_path", f"WITH RECURSIVE {PAIRS_SQL}, {cells_sql(_LINE, _BAND)}, {symmetric_sql()}, {PATH_SQL}" + """
SELECT sample_id, partner_id, step::INTEGER AS step, i::INTEGER AS i, j::INTEGER AS j FROM path JOIN pairs USING (pid)""")
def q_d3(spark, sf_dir):
    """D3 warping path of each pair as rows (sample, step, i, j)."""
    p = _pairs(spark, sf_dir)
    x = p.select("sample_id", "partner_id", D.dtw_path("symmetric", W)(F.col("series"), F.col("partner_series"))
                 .alias("path"))
    z = x.select("sample_id", "partner_id", F.posexplode(F.arrays_zip(F.col("path")[0].alias("i"),
                                                                      F.col("path")[1].alias("j"))).alias("step", "e"))
    return z.select("sample_id", "partner_id", "step", "e.i", "e.j")


@register("d4_group_medoids", f"""WITH RECURSIVE {_ORDERED},
g AS (SELECT *, pos // 6 AS grp FROM o),
pairs AS (SELECT row_number() OVER () AS pid, x.label, x.grp, x.sample_id, x.a AS a, y.a AS b
  FROM g AS x JOIN g AS y ON y.label = x.label AND y.grp = x.grp AND y.sample_id <> x.sample_id),
{cells_sql(_LINE, _BAND)}, {symmetric_sql()},
s AS (SELECT label, grp, sample_id, sum(v) AS dist_sum FROM dp JOIN pairs USING (pid)
  WHERE age = 0 AND i = len(a) AND d = len(a) + len(b) GROUP BY label, grp, sample_id),
b AS (SELECT label, grp, arg_min(sample_id, {{'d': dist_sum, 's': sample_id}}) AS medoid_id, min(dist_sum) AS dist_sum FROM s GROUP BY label, grp),
c AS (SELECT label, grp, count(*) AS members, min(sample_id) AS one FROM g GROUP BY label, grp)
SELECT label, grp AS "group", coalesce(medoid_id, one) AS medoid_id, coalesce(dist_sum, 0.0) AS dist_sum, members
FROM c LEFT JOIN b USING (label, grp)""", dbl=["dist_sum"])
def q_d4(spark, sf_dir):
    """D4 medoids of hash groups of 6 same-class samples (all pairs inside a group)."""
    return D.group_medoids(samples(spark, sf_dir), seed=0, size=6, window=W)


@register("d5_metric_dtw", distance_sql(weight=1.2), dbl=["dist"])
def q_d5(spark, sf_dir):
    """D5 DTW with band 7, off-diagonal weight 1.2, city-block distance."""
    p = _pairs(spark, sf_dir)
    return p.select("sample_id", "partner_id", D.metric_dtw("cityblock", warp=1, w=W, s=1.2)(
        F.col("series"), F.col("partner_series")).alias("dist"))


@register("d6_accelerated_dtw", distance_sql(band="true"), dbl=["dist"])
def q_d6(spark, sf_dir):
    """D6 unbanded DTW with a distance chosen by name (euclidean)."""
    p = _pairs(spark, sf_dir)
    return p.select("sample_id", "partner_id", D.metric_dtw("euclidean", warp=1, w=math.inf)(
        F.col("series"), F.col("partner_series")).alias("dist"))
