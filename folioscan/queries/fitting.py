"""Queries of page facts, calibration, principal axes and snapped endpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan import derive
from folioscan.operators import fitting as P
from folioscan.registry import query

SEG, PNT = derive.with_sql("segment"), derive.with_sql("point")


@query(
    SEG
    + """ SELECT sheet, count(*) AS n_paths, count(*) FILTER (floor(abs(ey - ay) * 2 / 100) < 0.5 AND abs(ex - ax) > 20) AS ruling_h, count(*) FILTER (abs(ex - ax) < 0.5 AND floor(abs(ey - ay) * 2 / 100) > 20) AS ruling_v,
 list_sort(list(DISTINCT layer)) AS layers FROM segment GROUP BY sheet"""
)
def a4_drawing_facts(spark, sf_dir):
    # heights fall to whole numbers, so that some segments are level
    s = derive.segments(spark, sf_dir)
    return P.drawing_facts(s.withColumn("ey", F.floor(F.abs(F.col("ey") - F.col("ay")) * 2 / 100).cast("double")).withColumn("ay", F.lit(0.0)), ["sheet"])


@query(SEG + " SELECT id, CASE WHEN id % 7 > 0 AND sqrt((ex-ax)*(ex-ax)+(ey-ay)*(ey-ay)) > 0 THEN (id % 7) / sqrt((ex-ax)*(ex-ax)+(ey-ay)*(ey-ay)) END AS per_unit FROM segment")
def g5_two_point_calibration(spark, sf_dir):
    s = derive.segments(spark, sf_dir)
    return s.select("id", P.calibrated(*map(F.col, ("ax", "ay", "ex", "ey")), (F.col("id") % 7).cast("double")).alias("per_unit"))


@query(
    PNT
    + """, s AS (SELECT cls, sheet, count(*) AS n, var_pop(x) AS a, var_pop(y) AS b, covar_pop(x, y) AS c FROM point GROUP BY ALL), m AS (SELECT *, (a + b) / 2 + sqrt(((a - b) / 2) * ((a - b) / 2) + c * c) AS big, greatest((a + b) / 2 - sqrt(((a - b) / 2) * ((a - b) / 2) + c * c), 1e-12) AS small FROM s)
SELECT cls, sheet, n, round(CASE WHEN n < 2 THEN 1 WHEN abs(c) > 1e-12 THEN (big - b) / sqrt((big - b) * (big - b) + c * c) WHEN a >= b THEN 1 ELSE 0 END, 6)::DOUBLE AS dx,
 round(CASE WHEN n < 2 THEN 0 WHEN abs(c) > 1e-12 THEN c / sqrt((big - b) * (big - b) + c * c) WHEN a >= b THEN 0 ELSE 1 END, 6)::DOUBLE AS dy, round(CASE WHEN n < 2 THEN 1 ELSE sqrt(big / small) END, 4)::DOUBLE AS elongation FROM m"""
)
def g10_principal_axes(spark, sf_dir):
    got = P.principal_axes(derive.points(spark, sf_dir), ["cls", "sheet"])
    return got.select("cls", "sheet", "n", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"), F.round("elongation", 4).alias("elongation"))


@query()
def a26_snapped_ends(spark, sf_dir):
    return P.snapped_ends(derive.segments(spark, sf_dir), ["sheet"], 6.0)
