"""Queries of markups and of ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan import derive
from folioscan.functions import geometry as G
from folioscan.operators import ordered as O
from folioscan.plans import markups as M
from folioscan.registry import query

MARK, SEG, PNT = derive.with_sql("markup"), derive.with_sql("segment"), derive.with_sql("point")


@query(MARK + " SELECT doc_key, page, xref FROM markup WHERE contains(lower(author), 'user')")
def p11_markups_by_author(spark, sf_dir):
    return M.by_author(derive.markups(spark, sf_dir), "USER").select("doc_key", "page", "xref")


@query(MARK + ", r AS (SELECT doc_key, page, irt_xref AS xref, count(*) AS n_replies, list(xref ORDER BY xref) AS replies FROM markup WHERE irt_xref IS NOT NULL GROUP BY 1, 2, 3) SELECT m.doc_key, m.page, m.xref, coalesce(n_replies, 0) AS n_replies, coalesce(replies, []) AS replies FROM markup m LEFT JOIN r USING (doc_key, page, xref)")
def j12_reply_threads(spark, sf_dir):
    return M.threads(derive.markups(spark, sf_dir)).select("doc_key", "page", "xref", "n_replies", "replies")


@query(
    MARK
    + """ SELECT a.doc_key, a.page, a.xref, arg_min(b.xref, ((b.x1-b.x0)*(b.y1-b.y0), b.xref)) AS target FROM markup a JOIN markup b ON a.doc_key = b.doc_key AND a.page = b.page AND a.xref <> b.xref
 AND a.tip_x BETWEEN b.x0 AND b.x1 AND a.tip_y BETWEEN b.y0 AND b.y1 AND coalesce(a.irt_xref <> b.xref, true) AND coalesce(b.irt_xref <> a.xref, true) AND b.turn <= a.turn GROUP BY ALL"""
)
def j13_aimed_at(spark, sf_dir):
    return M.aimed_at(derive.markups(spark, sf_dir))


_DUP = "(SELECT doc_key, page, xref, NULL::BIGINT AS irt_xref, kind, text, x0, y0, x1, y1 FROM markup)"


@query(
    MARK
    + f""", w AS {_DUP}
SELECT a.doc_key, a.page, a.xref, min(b.xref) AS duplicate_of FROM w a JOIN w b ON a.doc_key = b.doc_key AND a.page = b.page AND a.kind = b.kind AND lower(a.text) = lower(b.text) AND b.xref < a.xref
 AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)
 AND (least(a.x1,b.x1)-greatest(a.x0,b.x0))*(least(a.y1,b.y1)-greatest(a.y0,b.y0)) / least((a.x1-a.x0)*(a.y1-a.y0), (b.x1-b.x0)*(b.y1-b.y0)) > 0.5 GROUP BY ALL"""
)
def k2_duplicate_marks(spark, sf_dir):
    m = derive.markups(spark, sf_dir)
    return M.duplicate_marks(m.withColumn("irt_xref", F.lit(None).cast("long")))


@query(
    MARK
    + """, c AS (SELECT doc_key, page, xref AS id, text, x0, y0, x1, y1 FROM markup WHERE turn > 0), l AS (SELECT doc_key, page, text, x0 + 5 AS x0, y0, x1 + 5 AS x1, y1 FROM markup WHERE turn % 2 = 1)
SELECT doc_key, page, id FROM c WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.doc_key = c.doc_key AND l.page = c.page AND lower(regexp_replace(l.text, '\\s+', '', 'g')) = lower(regexp_replace(c.text, '\\s+', '', 'g'))
 AND least(l.x1,c.x1) > greatest(l.x0,c.x0) AND least(l.y1,c.y1) > greatest(l.y0,c.y0)
 AND (least(l.x1,c.x1)-greatest(l.x0,c.x0))*(least(l.y1,c.y1)-greatest(l.y0,c.y0)) >= 0.3 * ((l.x1-l.x0)*(l.y1-l.y0) + (c.x1-c.x0)*(c.y1-c.y0) - (least(l.x1,c.x1)-greatest(l.x0,c.x0))*(least(l.y1,c.y1)-greatest(l.y0,c.y0))))"""
)
def j11_hidden_text(spark, sf_dir):
    m = derive.markups(spark, sf_dir)
    cad = m.where("turn > 0").withColumnRenamed("xref", "id")
    layer = m.where("turn % 2 = 1").withColumn("x0", F.col("x0") + 5).withColumn("x1", F.col("x1") + 5)
    return M.hidden_only(cad, layer).select("doc_key", "page", "id")


@query(
    PNT
    + """, l AS (SELECT 'c' || cls AS doc_key, 0 AS page, pid AS ord, 't' || (pid % 3) AS text, x AS x0, y AS y0 FROM point)
SELECT doc_key, ord FROM l WHERE NOT EXISTS (SELECT 1 FROM l e WHERE e.doc_key = l.doc_key AND e.text = l.text AND e.ord < l.ord AND abs(e.x0 - l.x0) <= 8 AND abs(e.y0 - l.y0) <= 8)"""
)
def j20_overprints(spark, sf_dir):
    p = derive.points(spark, sf_dir)
    l = p.select(F.concat(F.lit("c"), F.col("cls").cast("string")).alias("doc_key"), F.lit(0).alias("page"), F.col("pid").alias("ord"), F.concat(F.lit("t"), (F.col("pid") % 3).cast("string")).alias("text"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    return M.without_overprints(l, 8.0).select("doc_key", "ord")


@query(derive.with_sql("page", "line", "markup") + " SELECT 'line' AS channel, count(*) AS n, sum(length(text))::BIGINT AS chars FROM line UNION ALL SELECT 'cad', count(*), sum(length(text))::BIGINT FROM markup WHERE turn > 0 UNION ALL SELECT 'markup', count(*), sum(length(text || ' | ' || author))::BIGINT FROM markup")
def u1_text_channels(spark, sf_dir):
    m = derive.markups(spark, sf_dir)
    every = M.channels(derive.lines(spark, sf_dir), m.where("turn > 0").withColumnRenamed("xref", "id"), m)
    return every.groupBy("channel").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(MARK + " SELECT xref, CASE WHEN x1 - x0 >= 0.95 * view THEN 'the box is the whole view' WHEN x1 - x0 > 80 AND x1 - x0 > 0.25 * view THEN 'the box is too wide to point at anything' END AS problem FROM (SELECT *, 60 + xref % 400 AS view FROM markup)")
def p25_anchor_problems(spark, sf_dir):
    m = derive.markups(spark, sf_dir).withColumn("view_width", 60 + F.col("xref") % 400)
    return m.select("xref", M.anchor_problem(80.0).alias("problem"))


@query(
    SEG
    + """, r AS (SELECT layer, x0, x1, max(x1) OVER (PARTITION BY layer ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM segment WHERE x1 - x0 < 8),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR x0 - reach > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY layer ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS g FROM r)
SELECT layer, min(x0) AS lo, max(x1) AS hi, count(*) AS n FROM i GROUP BY layer, g"""
)
def w11_joined_pieces(spark, sf_dir):
    s = derive.segments(spark, sf_dir).where("x1 - x0 < 8").select("layer", F.col("x0").alias("lo"), F.col("x1").alias("hi"))
    return O.joined_pieces(s, ["layer"], 3.0)


_RUN = "run AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS pos, event_id FROM events)"


def runs(spark, sf_dir):
    from pyspark.sql import Window

    e = derive.table(spark, sf_dir, "events")
    return e.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("pos"), "event_id")


@query(
    f"""WITH {_RUN}, v AS (SELECT user_id, pos, CASE WHEN user_id % 3 = 0 AND pos > 3 THEN pos + 1 ELSE pos END * (user_id % 5 + 1) + CASE WHEN user_id % 7 = 0 AND pos = 2 THEN 0.5::DOUBLE ELSE 0 END AS v FROM run),
s AS (SELECT user_id, lead(v) OVER (PARTITION BY user_id ORDER BY pos) - v AS step FROM v), b AS (SELECT *, min(abs(step)) OVER (PARTITION BY user_id) AS base FROM s WHERE step IS NOT NULL),
g AS (SELECT user_id, min(base)::DOUBLE AS base, count(*) AS n_steps, count(*) FILTER (abs(abs(step)/base - 2) <= 1e-6) AS n_double, count(*) FILTER (abs(abs(step)/base - 1) > 1e-6 AND abs(abs(step)/base - 2) > 1e-6) AS n_odd FROM b GROUP BY 1)
SELECT *, base > 0 AND n_odd = 0 AND n_double * 3 <= n_steps AS even FROM g"""
)
def w8_even_steps(spark, sf_dir):
    p, u = F.col("pos"), F.col("user_id")
    v = F.when((u % 3 == 0) & (p > 3), p + 1).otherwise(p) * (u % 5 + 1) + F.when((u % 7 == 0) & (p == 2), 0.5).otherwise(0.0)
    return O.steps_even(runs(spark, sf_dir).withColumn("v", v), ["user_id"], "pos", "v")


@query(
    f"""WITH {_RUN}, v AS (SELECT user_id, pos, 72.0::DOUBLE + 18 * (pos + CASE WHEN pos > 4 THEN 2 ELSE 0 END) AS y FROM run)
SELECT user_id, pos, y, CASE WHEN count(*) OVER (PARTITION BY user_id) = 1 THEN NULL ELSE 18.0::DOUBLE END AS step, ((y - min(y) OVER (PARTITION BY user_id)) / 18)::INT AS index FROM v QUALIFY count(*) OVER (PARTITION BY user_id) >= 4"""
)
def w9_grid_step(spark, sf_dir):
    from pyspark.sql import Window

    p = F.col("pos")
    r = runs(spark, sf_dir).withColumn("y", 72.0 + 18 * (p + F.when(p > 4, 2).otherwise(0))).drop("event_id")
    r = r.withColumn("n", F.count("*").over(Window.partitionBy("user_id"))).where("n >= 4").drop("n")
    return O.grid_step(r, ["user_id"], "y").select("user_id", "pos", "y", "step", "index")


@query()
def w7_monotone_run(spark, sf_dir):
    return O.monotone_run(runs(spark, sf_dir).withColumn("v", F.col("event_id") % 17).withColumn("v", F.col("v").cast("double")), ["user_id"], "pos", "v")


@query(f"WITH {_RUN} SELECT user_id, 2.5::DOUBLE AS slope, 10.0::DOUBLE AS intercept, count(*)::INT AS kept, 0 AS dropped FROM run GROUP BY 1 HAVING count(*) >= 3")
def g12_scale_fit(spark, sf_dir):
    f = O.fit_scales(runs(spark, sf_dir).withColumn("v", 10 + 2.5 * F.col("pos")), ["user_id"], "pos", "v")
    return f.where("refusal is null").select("user_id", F.round("slope", 9).alias("slope"), F.round("intercept", 7).alias("intercept"), "kept", "dropped")


@query(
    "WITH e AS (SELECT user_id, floor(epoch(ts))::BIGINT % 1000 AS x, value FROM events) SELECT user_id, round(regr_slope(value, x), 6) AS slope, round(regr_intercept(value, x), 4) AS intercept, count(*) AS n FROM e GROUP BY user_id HAVING count(DISTINCT x) > 2"
)
def a21_linear_regression(spark, sf_dir):
    e = derive.table(spark, sf_dir, "events").select("user_id", (F.unix_timestamp(F.col("ts").cast("timestamp")) % 1000).alias("x"), "value")
    g = e.groupBy("user_id").agg(F.round(F.regr_slope("value", "x"), 6).alias("slope"), F.round(F.regr_intercept("value", "x"), 4).alias("intercept"), F.count("*").alias("n"), F.count_distinct("x").alias("d"))
    return g.where("d > 2").drop("d")


@query(
    f"""WITH {_RUN}, s AS (SELECT *, event_id % 5 = 0 AS source, event_id % 5 IN (1, 2) AS eligible FROM run),
g AS (SELECT *, sum(CASE WHEN eligible THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY pos) AS isl FROM s)
SELECT user_id, pos, CASE WHEN first_value(source) OVER w AND NOT first_value(eligible) OVER w THEN 'r' || first_value(event_id) OVER w END AS role FROM g WINDOW w AS (PARTITION BY user_id, isl ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def w3_carried_role(spark, sf_dir):
    r = runs(spark, sf_dir).withColumn("own", F.concat(F.lit("r"), F.col("event_id").cast("string")))
    m = F.col("event_id") % 5
    return O.carried(r, ["user_id"], ["pos"], "own", m.isin(1, 2), m == 0, "role").select("user_id", "pos", "role")


@query("WITH q AS (SELECT vec_id AS id, floor(embedding[1]::DOUBLE * 3) AS x FROM embeddings) SELECT id, CASE WHEN x = 0 THEN 2 ELSE 3 END AS n_kept FROM q")
def w17_vertices_cleaned(spark, sf_dir):
    x = F.floor(F.col("embedding")[0].cast("double") * 3).cast("double")
    pt = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    v = F.array(pt(F.lit(0.0), F.lit(0.0)), pt(x, F.lit(0.0)), pt(x, F.lit(0.0)), pt(F.lit(9.0), F.lit(9.0)))
    return derive.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.size(O.vertices_cleaned(v)).alias("n_kept"))


@query()
def w18_joined_polylines(spark, sf_dir):
    s = derive.segments(spark, sf_dir)
    snap = lambda c: (F.round(F.col(c) / 50) * 50)
    lines = s.select("layer", "id", F.array(snap("ax"), snap("ex")).alias("xs"), F.array(snap("ay"), snap("ey")).alias("ys"))
    return O.joined_polylines(lines, ["layer"])


@query()
def o4_suppressed_hits(spark, sf_dir):
    s = derive.segments(spark, sf_dir).select("layer", "id", ((F.col("id") * 37 % 101) / 101).alias("score"), "x0", "y0", "x1", "y1")
    return O.suppressed(s, ["layer"])


@query(SEG + " SELECT id, CASE WHEN turn <= -180 THEN 180 ELSE turn END AS turn FROM (SELECT id, round(degrees(atan2((ex-ax)*(-1) - (ey-ay)*0, (ex-ax)*0 + (ey-ay)*(-1))), 6) AS turn FROM segment WHERE ex <> ax OR ey <> ay)")
def w19_turn_angles(spark, sf_dir):
    s = derive.segments(spark, sf_dir).where("ex <> ax or ey <> ay")
    pt = lambda a, b: F.struct(F.col(a).cast("double").alias("x") if isinstance(a, str) else a.alias("x"), F.col(b).cast("double").alias("y") if isinstance(b, str) else b.alias("y"))
    ring = F.array(pt("ax", "ay"), pt("ex", "ey"), pt(F.col("ex"), F.col("ey") - 1))
    return s.select("id", F.round(G.turn_angles(ring)[1], 6).alias("turn"))
