"""Queries of scales, rulers, logs and readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan import derive
from folioscan.plans import scales as S
from folioscan.registry import query


@query(
    """WITH s AS (SELECT p_brand AS doc_key, p_partkey::INT AS page, unnest([0, 1, 2]) AS k, p_size FROM part),
v AS (SELECT doc_key, page, 's' || k AS scale_id, ['stated', 'stored', 'bar'][k + 1] AS source, CASE k WHEN 0 THEN p_size * (1 + (page % 5) / 100::DOUBLE) WHEN 1 THEN p_size ELSE p_size * 2 END::DOUBLE AS per_point FROM s WHERE NOT (k = 1 AND page % 3 = 0)),
r AS (SELECT *, CASE source WHEN 'stored' THEN 0 WHEN 'bar' THEN 1 ELSE 2 END AS rk FROM v), p AS (SELECT *, arg_min(scale_id, rk) OVER w AS pid, arg_min(per_point, rk) OVER w AS pp FROM r WINDOW w AS (PARTITION BY doc_key, page))
SELECT doc_key, page, scale_id, scale_id = pid AS primary, abs(per_point - pp) / pp AS gap,
 CASE WHEN source = 'stated' AND abs(per_point - pp) / pp <= 0.02 THEN 0.9 WHEN source = 'stored' THEN 0.98 WHEN source = 'bar' THEN 0.95 ELSE 0.7 END::DOUBLE AS confidence,
 CASE WHEN scale_id <> pid AND abs(per_point - pp) / pp > 0.02 THEN 'differs from ' || pid END AS warning FROM p""".replace("AS primary", 'AS "primary"')
)
def x21_reconciled_scales(spark, sf_dir):
    k, size = F.col("k"), F.col("p_size")
    rows = derive.table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_key"), F.col("p_partkey").cast("int").alias("page"), "p_size", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")).where(~((k == 1) & (F.col("page") % 3 == 0)))
    per = F.when(k == 0, size * (1 + (F.col("page") % 5) / 100)).when(k == 1, size.cast("double")).otherwise(size * 2.0)
    s = rows.select("doc_key", "page", F.concat(F.lit("s"), k.cast("string")).alias("scale_id"), F.element_at(F.array(*map(F.lit, ("stated", "stored", "bar"))), k + 1).alias("source"), per.alias("per_point"))
    return S.reconciled(s).drop("source", "per_point")


@query("SELECT p_brand AS doc_key, p_partkey::INT AS ord, (CASE WHEN p_partkey % 2 = 0 THEN p_size * 0.3048::DOUBLE / 0.0254::DOUBLE / 1 ELSE p_size * 10 END)::DOUBLE AS magnification, CASE WHEN p_partkey % 2 = 0 THEN 0.85 ELSE 0.45 END::DOUBLE AS confidence FROM part WHERE p_size >= 10")
def f15_scale_notes(spark, sf_dir):
    s = F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("SCALE 1 in = "), s, F.lit(" ft (plan)"))).otherwise(F.concat(F.lit("about 1:"), s, F.lit("0 here")))
    lines = derive.table(spark, sf_dir, "part").where("p_size >= 10").select(F.col("p_brand").alias("doc_key"), F.lit(0).alias("page"), F.col("p_partkey").cast("int").alias("ord"), text.alias("text"))
    return S.scale_notes(lines).drop("page", "ratio")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN pow(10::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * (p_size % 20)) ELSE 0.5::DOUBLE + 0.1::DOUBLE * p_size END AS value FROM part")
def g13_values(spark, sf_dir):
    log = F.col("p_partkey") % 3 == 0
    s = F.when(log, F.col("p_size") % 20).otherwise(F.col("p_size")).cast("double")
    return derive.table(spark, sf_dir, "part").select("p_partkey", S.value_at(s, F.lit(0.1), F.lit(0.5), F.when(log, "log10").otherwise("linear")).alias("value"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 AND p_size > 0 AND NOT (p_partkey % 4 = 1) THEN p_size / 72::DOUBLE END AS factor, CASE WHEN p_partkey % 4 <> 0 AND NOT (p_partkey % 4 = 1) THEN 'ft' END AS unit FROM part")
def g4_viewport_factors(spark, sf_dir):
    k = F.col("p_partkey")
    v = derive.table(spark, sf_dir, "part").select("p_partkey", F.when(k % 4 == 0, "geo").otherwise("rect").alias("kind"), F.when(k % 4 == 1, "1:1").otherwise("1 in = 20 ft").alias("ratio"), F.when(k % 4 == 1, "pt").otherwise("Feet").alias("x_unit"), (F.col("p_size") / 72).alias("x_per_point"))
    return S.viewport_factor(v).select("p_partkey", "factor", "unit")


@query(
    """WITH l AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS ord FROM events)
SELECT run_id, ord, 40.0::DOUBLE * ord + CASE WHEN run_id % 2 = 0 THEN 3 ELSE 0 END AS position, CASE WHEN run_id % 2 = 0 AND n >= 2 THEN 0.5 ELSE 0.75 * 8 + 0.5 END::DOUBLE AS plus_minus, CASE WHEN run_id % 2 = 0 AND n >= 2 THEN 'tick' ELSE 'label' END AS anchored_by
FROM (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM l) WHERE run_id % 2 = 1 OR n >= 2"""
)
def j27_label_anchors(spark, sf_dir):
    from pyspark.sql import Window

    e = derive.table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("ord"))
    e = e.withColumn("n", F.count("*").over(Window.partitionBy("run_id"))).where("run_id % 2 = 1 or n >= 2").drop("n")
    labels = e.withColumn("mid", 40.0 * F.col("ord")).withColumn("height", F.lit(8.0))
    ticks = e.where("run_id % 2 = 0").select("run_id", (40.0 * F.col("ord") + 3).alias("at"))
    return S.anchors(labels, ticks)


@query("SELECT p_brand AS doc_key, arg_max(p_partkey, (CASE WHEN p_partkey % 5 = 0 THEN 10.0 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 THEN 1.5 ELSE 0 END + p_size / 10::DOUBLE, p_partkey)) AS column, max(CASE WHEN p_partkey % 5 = 0 THEN 10.0 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 THEN 1.5 ELSE 0 END + p_size / 10::DOUBLE) AS score FROM part WHERE p_size % 6 >= 3 AND p_partkey % 3 <> 1 GROUP BY 1".replace("AS column", 'AS "column"'))
def x17_depth_rulers(spark, sf_dir):
    k = F.col("p_partkey")
    c = derive.table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_key"), k.alias("column"), F.when(k % 5 == 0, "DEPTH (ft)").otherwise("N value").alias("header"), (k % 2 == 0).alias("even"), F.col("p_size").alias("n_ticks"), (F.col("p_size") % 6).alias("n_labels"), (k % 3 != 1).alias("rising"))
    return S.ruler_candidates(c)


@query(
    """WITH b AS (SELECT DISTINCT 'u' || (user_id % 20) AS doc_key, (event_id % 40 * 10)::DOUBLE AS y FROM events), d AS (SELECT 'u' || (user_id % 20) AS doc_key, (event_id % 300)::DOUBLE + 0.5 AS loc, 't' || event_id AS text FROM events),
n AS (SELECT *, lead(y) OVER (PARTITION BY doc_key ORDER BY y) AS nxt FROM b),
s AS (SELECT n.doc_key, y, any_value(nxt) AS nxt, string_agg(text, ' ' ORDER BY loc, text) AS description FROM n LEFT JOIN d ON d.doc_key = n.doc_key AND loc >= y AND loc < coalesce(nxt, 1e9) GROUP BY n.doc_key, y),
l AS (SELECT *, max(CASE WHEN description IS NOT NULL THEN y END) OVER (PARTITION BY doc_key) AS last FROM s)
SELECT doc_key, y AS top, CASE WHEN y < last THEN nxt END AS bottom, 0.85::DOUBLE AS confidence, description FROM l WHERE y <= last"""
)
def w13_layers(spark, sf_dir):
    e = derive.table(spark, sf_dir, "events").withColumn("doc_key", F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")))
    b = e.select("doc_key", (F.col("event_id") % 40 * 10).cast("double").alias("y"), F.lit("rule").alias("kind")).distinct()
    d = e.select("doc_key", ((F.col("event_id") % 300) + 0.5).alias("at"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("text"))
    return S.layers(b, d)


@query(
    """WITH b AS (SELECT DISTINCT 'u' || (user_id % 20) AS doc_key, (event_id % 40 * 10)::DOUBLE AS y FROM events), n AS (SELECT doc_key, y AS top, lead(y) OVER (PARTITION BY doc_key ORDER BY y) AS bottom FROM b),
d AS (SELECT 'u' || (user_id % 20) AS doc_key, (event_id % 300)::DOUBLE + 0.5 AS loc, 'S-' || event_id AS label FROM events)
SELECT n.doc_key, top, bottom, arg_min(label, (loc, label)) AS label FROM n JOIN d ON n.doc_key = d.doc_key AND loc >= top AND loc < bottom GROUP BY ALL"""
)
def w14_samples(spark, sf_dir):
    e = derive.table(spark, sf_dir, "events").withColumn("doc_key", F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")))
    b = e.select("doc_key", (F.col("event_id") % 40 * 10).cast("double").alias("y")).distinct()
    d = e.select("doc_key", ((F.col("event_id") % 300) + 0.5).alias("at"), F.concat(F.lit("S-"), F.col("event_id").cast("string")).alias("label"))
    return S.samples(b, d)


@query("SELECT l_orderkey, l_linenumber, (l_partkey % 600) // 150 AS \"column\", 2.0::DOUBLE + 0.05::DOUBLE * (l_orderkey % 700) AS depth FROM lineitem")
def j26_cells(spark, sf_dir):
    l = derive.table(spark, sf_dir, "lineitem").select(F.lit("d").alias("doc_key"), F.struct("l_orderkey", "l_linenumber").alias("ord"), (F.col("l_partkey") % 600).cast("double").alias("xc"), (F.col("l_orderkey") % 700).cast("double").alias("yc"))
    cols = spark.range(4).select(F.lit("d").alias("doc_key"), F.col("id").alias("column"), (F.col("id") * 150.0).alias("lo"), ((F.col("id") + 1) * 150.0).alias("hi"))
    fits = spark.createDataFrame([("d", 0.05, 2.0)], "doc_key string, slope double, intercept double")
    return S.cells(l, cols, fits).select("ord.l_orderkey", "ord.l_linenumber", "column", "depth")


@query(
    derive.with_sql("segment")
    + """, l AS (SELECT id, layer AS doc_key, ax AS x0, ay AS y0, ax + 20 AS x1, ay + 8 AS y1 FROM segment WHERE id % 2 = 0), v AS (SELECT id, layer AS doc_key, ax AS x0, ay AS y0, ax + 20 AS x1, ay + 8 AS y1 FROM segment WHERE id % 2 = 1)
SELECT l.doc_key, l.id AS label_id, arg_min(v.id, (greatest(v.x0 - l.x1, 0) + greatest(v.y0 - l.y1, 0), v.id)) AS value_id FROM l JOIN v ON l.doc_key = v.doc_key AND v.x0 <= l.x1 + 70 AND v.x1 >= l.x0 AND v.y0 <= l.y1 + 6 AND v.y1 >= l.y0
 AND ((v.x0 >= l.x1 AND v.y0 < l.y1) OR v.y0 >= l.y1) GROUP BY ALL"""
)
def j28_values_beside(spark, sf_dir):
    s = derive.segments(spark, sf_dir).select(F.col("layer").alias("doc_key"), "id", F.col("ax").alias("x0"), F.col("ay").alias("y0"), (F.col("ax") + 20).alias("x1"), (F.col("ay") + 8).alias("y1"))
    return S.value_beside(s.where("id % 2 = 0"), s.where("id % 2 = 1"))


@query(
    derive.with_sql("segment")
    + """, b AS (SELECT layer AS doc_key, id AS box_id, y0, y0 + 4 AS y1 FROM segment), l AS (SELECT layer AS doc_key, ay AS y FROM segment),
n AS (SELECT b.doc_key, box_id, any_value(b.y0) AS y0, any_value(b.y1) AS y1, count(y) AS n_lines, min(y) AS y FROM b LEFT JOIN l ON l.doc_key = b.doc_key AND y >= y0 - 6 AND y < y1 + 6 GROUP BY ALL)
SELECT doc_key, box_id, 5 + 0.5::DOUBLE * CASE n_lines WHEN 1 THEN y WHEN 0 THEN (y0 + y1) / 2 END AS value, CASE WHEN n_lines = 0 THEN 3.0::DOUBLE END AS plus_minus, n_lines, CASE n_lines WHEN 1 THEN 'read' WHEN 0 THEN 'unsnapped' ELSE 'ambiguous' END AS status FROM n"""
)
def x23_line_readings(spark, sf_dir):
    s = derive.segments(spark, sf_dir)
    b = s.select(F.col("layer").alias("doc_key"), F.col("id").alias("box_id"), "y0", (F.col("y0") + 4).alias("y1"))
    fits = s.select(F.col("layer").alias("doc_key")).distinct().select("doc_key", F.lit(0.5).alias("slope"), F.lit(5.0).alias("intercept"))
    return S.read_line(s.select(F.col("layer").alias("doc_key"), F.col("ay").alias("y")), b, fits)


@query("SELECT l_orderkey, l_linenumber, printf('%.1f', round_even(l_quantity * 1.25::DOUBLE, 1)) || ' +/- 0.3' AS shown FROM lineitem")
def f26_display_values(spark, sf_dir):
    return derive.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.display_value(F.col("l_quantity") * 1.25, F.lit(0.23), F.lit(None).cast("double")).alias("shown"))


@query(
    """WITH p AS (SELECT n_regionkey AS f, (n_nationkey * 10)::DOUBLE AS x, n_nationkey % 7 + 1.0::DOUBLE AS z FROM nation), m AS (SELECT f, min(x) AS lo, max(x) AS hi FROM p GROUP BY f)
SELECT f, CASE WHEN f = 4 THEN 'first only' ELSE 'both' END AS status, CASE WHEN f <> 4 THEN 0.5::DOUBLE END AS mean_dev, CASE WHEN f <> 4 THEN 0.5::DOUBLE END AS max_dev FROM m"""
)
def j31_g21_profiles(spark, sf_dir):
    n = derive.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("f"), F.col("n_nationkey").alias("seq"), (F.col("n_nationkey") * 10).cast("double").alias("x"), (F.col("n_nationkey") % 7 + 1.0).alias("z"))
    got = S.profiles_compared(n, n.where("f <> 4").withColumn("z", F.col("z") + 0.5), ["f"])
    return got.select("f", "status", F.round("mean_dev", 9).alias("mean_dev"), F.round("max_dev", 9).alias("max_dev"))
