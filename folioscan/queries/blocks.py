"""Queries of title blocks, schedule parts, mark context, decades and plan grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan import derive
from folioscan.operators import spatial as A
from folioscan.plans import titleblocks as B
from folioscan.registry import query

SEG, PNT = derive.with_sql("segment"), derive.with_sql("point")


def _block(spark, sf_dir):
    """Two lines a part: a SCALE label with its value beside or under it."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    p = derive.table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_key"), k.cast("int").alias("page"), k, s.alias("s"))
    value = F.when(k % 3 == 2, "AS NOTED").otherwise(F.concat(F.lit("1 in = "), F.col("s"), F.lit(" ft")))
    rows = F.array(
        F.struct(F.lit(0).alias("ord"), F.when(k % 2 == 0, F.concat(F.lit("SCALE: "), value)).otherwise("SCALE:").alias("text"), F.lit(100.0).alias("y0")),
        F.struct(F.lit(1).alias("ord"), F.when(k % 2 == 0, "other").otherwise(value).alias("text"), F.lit(112.0).alias("y0")),
    )
    return p.select("doc_key", "page", F.inline(rows)).select("*", F.lit(10.0).alias("x0"), F.lit(90.0).alias("x1"), (F.col("y0") + 10).alias("y1"))


@query("SELECT p_brand AS doc_key, p_partkey::INT AS page, CASE WHEN p_partkey % 3 = 2 THEN 'AS NOTED' ELSE '1 in = ' || p_size || ' ft' END AS value, CASE WHEN p_partkey % 3 <> 2 AND p_size > 0 THEN p_size * 0.3048::DOUBLE / 0.0254::DOUBLE / 1 END AS magnification, CASE WHEN p_partkey % 3 = 2 THEN 'no one scale' ELSE 'ratio' END AS stated FROM part")
def f18_sheet_scales(spark, sf_dir):
    return B.sheet_scales(B.cell_values(_block(spark, sf_dir), r"(?i)^\s*scale\b\s*[:=]?\s*"))


@query("SELECT p_brand AS doc_key, p_size % 5 AS page, chr((65 + max(p_partkey % 4))::INT) AS revision FROM part GROUP BY ALL")
def f18_latest_revisions(spark, sf_dir):
    k = F.col("p_partkey")
    mark = F.concat(F.chr(65 + k % 4), F.lit("  2024-03-0"), (k % 9 + 1).cast("string"), F.lit(" issued"))
    rows = derive.table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_key"), (F.col("p_size") % 5).alias("page"), mark.alias("text"))
    return B.latest_revisions(rows.unionByName(rows.withColumn("text", F.lit("3 2023-01-02 draft"))))


@query("SELECT p_brand AS doc_key, 'PUMP SCHEDULE ' || (p_size % 3) AS schedule, count(*) AS n_parts, list_sort(list_distinct(list('c' || (p_partkey % 4)))) AS columns FROM part GROUP BY ALL")
def w16_joined_schedules(spark, sf_dir):
    k, n = F.col("p_partkey"), (F.col("p_size") % 3).cast("string")
    title = F.when(k % 2 == 0, F.concat(F.lit("Pump  Schedule "), n, F.lit(" (Continued)"))).otherwise(F.concat(F.lit("PUMP SCHEDULE "), n))
    return B.joined_schedules(derive.table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_key"), title.alias("title"), F.array(F.concat(F.lit("c"), (k % 4).cast("string"))).alias("columns")))


@query(
    SEG
    + """, h AS (SELECT id AS hit_id, layer AS doc_key, ax AS x0, ay AS y0, ax + 20 AS x1, ay + 16 AS y1 FROM segment WHERE id % 2 = 0), r AS (SELECT layer AS doc_key, ax - 30 AS rx0, ay AS ry, ax + 60 AS rx1 FROM segment WHERE id % 2 = 1)
SELECT h.hit_id, CASE WHEN coalesce(bool_or(ry <= y0), false) AND coalesce(bool_or(ry >= y1), false) THEN 'table_row' ELSE 'plan' END AS context FROM h LEFT JOIN r ON h.doc_key = r.doc_key AND rx0 <= x1 AND rx1 >= x0 AND ry BETWEEN y0 - 8 AND y1 + 8 GROUP BY ALL"""
)
def j30_hit_context(spark, sf_dir):
    s = derive.segments(spark, sf_dir).withColumn("doc_key", F.col("layer")).withColumn("page", F.lit(0))
    hits = s.where("id % 2 = 0").select("doc_key", "page", F.col("id").alias("hit_id"), F.col("ax").alias("x0"), F.col("ay").alias("y0"), (F.col("ax") + 20).alias("x1"), (F.col("ay") + 16).alias("y1"))
    rules = s.where("id % 2 = 1").select("doc_key", "page", (F.col("ax") - 30).alias("rx0"), F.col("ay").alias("ry"), (F.col("ax") + 60).alias("rx1"))
    return B.hit_context(hits, rules).select("hit_id", "context")


@query("SELECT s_suppkey, 0 AS phase, 100.0::DOUBLE AS start, 17 AS matched FROM supplier WHERE s_suppkey % 2 = 0")
def w10_log_decades(spark, sf_dir):
    s = derive.table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select("s_suppkey")
    at = F.transform(F.sequence(F.lit(0), F.lit(18)), lambda i: 100 + 50 * (F.floor(i / 9) + F.log10(i % 9 + 1)))
    odd = derive.table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 1").select("s_suppkey", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: 10.0 * i)).alias("x"))
    return B.log_decades(s.select("s_suppkey", F.explode(at).alias("x")).unionByName(odd), ["s_suppkey"], "x").select("s_suppkey", F.col("phase").cast("int").alias("phase"), F.round("start", 9).alias("start"), F.col("matched").cast("int").alias("matched"))


@query(PNT + " SELECT pid, round(1000 + 2 * x - 0.5::DOUBLE * y, 6) AS easting, round(500 + 0.5::DOUBLE * x + 2 * y, 6) AS northing FROM point")
def g16_x27_j33_plan_grid(spark, sf_dir):
    p = derive.points(spark, sf_dir)
    controls = p.select(F.lit("set").alias("s"), F.col("x").alias("px"), (-F.col("y")).alias("py"), (1000 + 2 * F.col("x") - 0.5 * F.col("y")).alias("easting"), (500 + 0.5 * F.col("x") + 2 * F.col("y")).alias("northing"))
    fits = A.similarity_fit(controls, ["s"])
    at = A.to_ground(p.select(F.lit("set").alias("s"), "pid", F.col("x").alias("px"), (-F.col("y")).alias("py")), fits, ["s"])
    return at.select("pid", F.round("easting", 6).alias("easting"), F.round("northing", 6).alias("northing"))
