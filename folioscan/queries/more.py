"""Queries of reading order, requests, rings, votes and repeated marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan import derive
from folioscan.functions import geometry as G
from folioscan.functions import quantities as Q
from folioscan.operators import rings
from folioscan.operators import spatial as A
from folioscan.plans import reading as R
from folioscan.plans import requests as W
from folioscan.queries.sets import index
from folioscan.registry import query
from folioscan.sources import layout_json

SEG, PNT, LINE, MARK = (derive.with_sql(*n) for n in (("segment",), ("point",), ("page", "line"), ("markup",)))

#: Two columns on pages with an even number, and a heading across.
_COLS = """l AS (SELECT doc_key, page, ord, text, CASE WHEN page % 2 = 0 AND ord % 2 = 1 THEN 320 ELSE 72 END::DOUBLE AS x0, CASE WHEN ord = -1 THEN 540 WHEN page % 2 = 0 AND ord % 2 = 0 THEN 280 WHEN page % 2 = 0 THEN 540 ELSE 300 END::DOUBLE AS x1,
 CASE WHEN ord = -1 THEN 20 ELSE 100 + 12 * (ord // 2) END::DOUBLE AS y0, CASE WHEN ord = -1 THEN 30 ELSE 110 + 12 * (ord // 2) END::DOUBLE AS y1 FROM line)"""


def column_lines(spark, sf_dir):
    o, p = F.col("ord"), F.col("page")
    head, even = o == -1, p % 2 == 0
    y = F.when(head, 20.0).otherwise(100.0 + 12 * F.floor(o / 2))
    l = derive.lines(spark, sf_dir).select("doc_key", "page", "ord", "text", F.when(~head & even & (o % 2 == 1), 320.0).when(head & even, 320.0 - 248).otherwise(72.0).alias("x0"), F.when(head, 540.0).when(even & (o % 2 == 0), 280.0).when(even, 540.0).otherwise(300.0).alias("x1"), y.alias("y0"), (y + 10).alias("y1"))
    return l.withColumn("width", F.lit(612.0))


_COLS = _COLS.replace("CASE WHEN page % 2 = 0 AND ord % 2 = 1 THEN 320", "CASE WHEN ord >= 0 AND page % 2 = 0 AND ord % 2 = 1 THEN 320")


@query(
    LINE
    + f""", {_COLS}, n AS (SELECT doc_key, page, count(*) FILTER (x1 = 280) AS a, count(*) FILTER (x0 = 320) AS b FROM l GROUP BY ALL),
c AS (SELECT l.*, a >= 4 AND b >= 4 AS two FROM l JOIN n USING (doc_key, page)),
k AS (SELECT *, CASE WHEN two AND x0 = 72 AND x1 = 540 THEN NULL WHEN two AND x0 = 320 THEN 1 ELSE 0 END AS "column" FROM c)
SELECT doc_key, page, ord, "column", (row_number() OVER (PARTITION BY doc_key, page ORDER BY CASE WHEN "column" IS NULL THEN 1 WHEN two AND EXISTS (SELECT 1 FROM k h WHERE h.doc_key = k.doc_key AND h.page = k.page AND h."column" IS NULL) THEN 2 ELSE 0 END, coalesce("column", 0), y0, x0, ord) - 1)::INT AS place FROM k"""
)
def w12_column_order(spark, sf_dir):
    return R.column_order(column_lines(spark, sf_dir)).select("doc_key", "page", "ord", "column", "place")


@query(LINE + ", d AS (SELECT doc_key, count(DISTINCT page) AS n FROM line GROUP BY 1), t AS (SELECT doc_key, text, count(DISTINCT page) AS n_pages FROM line GROUP BY ALL) SELECT doc_key, text, n_pages FROM t JOIN d USING (doc_key) WHERE n_pages >= greatest(3, 0.1 * n)")
def a16_repeated_texts(spark, sf_dir):
    return R.repeated_texts(derive.lines(spark, sf_dir), 0.1)


@query(
    derive.with_sql("page", "markup")
    + """, h AS (SELECT doc_key, page, xref, x0 AS x, y0 AS y FROM markup), p AS (SELECT DISTINCT doc_key, page, CASE WHEN page % 3 = 0 THEN 792 ELSE 612 END AS w FROM markup),
j AS (SELECT h.*, w, floor(x / 150) AS cx, floor(y / 150) AS cy FROM h JOIN p USING (doc_key, page)), n AS (SELECT doc_key, w, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT doc_key, w, cx, cy, count(DISTINCT page) AS on_sheets FROM j GROUP BY ALL)
SELECT doc_key, page, xref, on_sheets, on_sheets >= greatest(3, 0.25 * n) AS repeats FROM j JOIN s USING (doc_key, w, cx, cy) JOIN n USING (doc_key, w)"""
)
def a17_repeated_hits(spark, sf_dir):
    m = derive.markups(spark, sf_dir)
    hits = m.select("doc_key", "page", "xref", F.col("x0").alias("x"), F.col("y0").alias("y"))
    pages = m.select("doc_key", "page", F.when(F.col("page") % 3 == 0, 792).otherwise(612).alias("width"), F.lit(1).alias("height")).distinct()
    return R.repeated_hits(hits, pages, 150.0, 0.25).drop("x", "y")


@query(SEG + ", t AS (SELECT sheet, 'T' || id AS text, ax AS x, ay AS y FROM segment), e AS (SELECT id, sheet, ex AS x, ey AS y FROM segment) SELECT e.sheet, e.id, arg_min(text, (sqrt((e.x-t.x)*(e.x-t.x)+(e.y-t.y)*(e.y-t.y)), text)) AS near FROM e JOIN t ON e.sheet = t.sheet AND sqrt((e.x-t.x)*(e.x-t.x)+(e.y-t.y)*(e.y-t.y)) <= 30 GROUP BY ALL")
def j32_near_text(spark, sf_dir):
    s = derive.segments(spark, sf_dir)
    texts = s.select("sheet", F.concat(F.lit("T"), F.col("id").cast("string")).alias("text"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    return R.near_text(s.select("sheet", "id", F.col("ex").alias("x"), F.col("ey").alias("y")), texts, 30.0, ["sheet"])


@query(LINE + " SELECT doc_key, page, ord, '[p' || page || '.t' || ord || ' @ 72,' || round_even(y0, 0)::BIGINT || ',540,' || round_even(y1, 0)::BIGINT || '] ' || text AS line FROM line")
def k7_rendered_lines(spark, sf_dir):
    return R.rendered(derive.lines(spark, sf_dir).withColumn("x0", F.lit(72.0)).withColumn("x1", F.lit(540.0)))


@query("SELECT p_partkey, p_size::DOUBLE AS value, 'ft' AS units, CASE WHEN p_partkey % 3 <> 0 THEN p_size * (1 + (p_partkey % 10) / 100::DOUBLE) END AS measured, CASE WHEN p_partkey % 3 <> 0 THEN abs(p_size - p_size * (1 + (p_partkey % 10) / 100::DOUBLE)) / (p_size * (1 + (p_partkey % 10) / 100::DOUBLE)) <= 0.05 END AS agrees FROM part")
def x30_stated_and_measured(spark, sf_dir):
    p = derive.table(spark, sf_dir, "part")
    said = Q.mentions(p.select("p_partkey", F.concat(F.lit("space bolts "), F.col("p_size").cast("string"), F.lit(" ft apart")).alias("text")), ["p_partkey"], kinds=["length"])
    seen = p.where("p_partkey % 3 <> 0").select("p_partkey", F.lit("ft").alias("units"), (F.col("p_size") * (1 + (F.col("p_partkey") % 10) / 100)).alias("value"))
    return R.stated_and_measured(said.select("p_partkey", "value", "units"), seen, ["p_partkey"])


@query(
    """WITH r AS (SELECT doc_id AS request_id, (doc_id % 50)::INT AS page, doc_id % 4 AS m, doc_id % 7 AS k FROM documents)
SELECT request_id, page, CASE WHEN k <> 0 AND m = 0 THEN 5 WHEN k <> 0 AND m = 1 THEN 10 END::DOUBLE AS x0, CASE WHEN k = 0 THEN NULL WHEN m = 0 THEN 'quote' WHEN m = 1 THEN 'box' WHEN m = 2 THEN 'reply' END AS anchor,
 CASE WHEN k = 0 THEN 'no such kind of markup' WHEN m = 3 THEN 'the box is not on the page' END AS refused FROM r"""
)
def k1_requests(spark, sf_dir):
    i = F.col("doc_id")
    d = derive.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.floor(i / 50).cast("string")).alias("doc_key"), (i % 50).cast("int").alias("page"), i.alias("request_id"))
    m, k = F.col("request_id") % 4, F.col("request_id") % 7
    req = d.withColumn("kind", F.when(k == 0, "scribble").otherwise("box")).withColumn("quote", F.when(m == 0, "that")).withColumn("reply_to", F.when(m == 2, F.lit("x")))
    req = req.withColumn("x0", F.when(m == 3, 9000.0).otherwise(10.0)).withColumn("y0", F.lit(10.0)).withColumn("x1", F.col("x0") + 5).withColumn("y1", F.lit(20.0))
    quotes = d.select("doc_key", "page", F.lit("that").alias("quote"), F.lit(5.0).alias("qx0"), F.lit(5.0).alias("qy0"), F.lit(9.0).alias("qx1"), F.lit(9.0).alias("qy1"))
    return W.resolved(req, derive.pages(spark, sf_dir), quotes).select("request_id", "page", "x0", "anchor", "refused")


@query("SELECT s_suppkey AS uid, CASE WHEN s_suppkey % 3 = 0 THEN 'old' ELSE 'new' END AS says FROM supplier WHERE s_suppkey % 3 <> 2 OR s_suppkey % 2 = 0".replace("WHERE s_suppkey % 3 <> 2 OR s_suppkey % 2 = 0", "WHERE s_suppkey % 3 = 0 OR s_suppkey % 2 = 0"))
def k3_copy_after_edits(spark, sf_dir):
    s = derive.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("uid"))
    old = s.where("uid % 3 <> 2").withColumn("says", F.lit("old"))
    return W.after_edits(old, s.where("uid % 2 = 0").withColumn("says", F.lit("new")), s.where("uid % 3 = 1"))


@query("SELECT s_suppkey::INT AS page, '1 in = ' || (s_suppkey % 90 + 10) || ' ft' AS ratio, s_suppkey / 100::DOUBLE AS x_per_point, 'ft' AS x_unit, 10.0::DOUBLE AS x0, 20.0::DOUBLE AS y0, 300.0::DOUBLE + s_suppkey AS x1, 400.5::DOUBLE AS y1 FROM supplier")
def s21_viewports(spark, sf_dir):
    k = F.col("s_suppkey")
    obj = F.concat(F.lit("<< /BBox [10 400.5 "), (300 + k).cast("string"), F.lit(" 20] /Measure << /R (1 in = "), (k % 90 + 10).cast("string"), F.lit(" ft) /X [<< /C "), F.format_string("%.2f", k / 100), F.lit(" /U (feet) >>] >> >>"))
    return W.parsed_viewports(derive.table(spark, sf_dir, "supplier").select(F.lit("d").alias("doc_key"), k.cast("int").alias("page"), obj.alias("object"))).drop("doc_key")


@query("SELECT s_suppkey AS xref, (s_suppkey % 50 + 1)::DOUBLE AS stated_ft, CASE WHEN s_suppkey % 4 <> 0 THEN (s_suppkey % 50 + 1) * CASE WHEN s_suppkey % 3 = 0 THEN 1.1::DOUBLE ELSE 1 END END AS derived_ft, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 3 <> 0 END AS agrees FROM supplier")
def s22_dimension_measures(spark, sf_dir):
    k = F.col("s_suppkey")
    n = (k % 50 + 1).cast("double")
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    per = F.when(k % 4 != 0, F.when(k % 3 == 0, 1.1).otherwise(1.0))
    m = derive.table(spark, sf_dir, "supplier").select(k.alias("xref"), F.concat((k % 50 + 1).cast("string"), F.lit("'")).alias("contents"), F.array(pt(F.lit(0.0), F.lit(0.0)), pt(n, F.lit(0.0))).alias("vertices"), per.alias("per_point"), F.lit("ft").alias("unit"))
    return W.dimension_measures(m).drop("ratio")


@query("SELECT s_suppkey AS answer_id, k::INT AS ord, CASE k WHEN 0 THEN 'grid' ELSE 'px' END AS frame, CASE k WHEN 0 THEN 10 ELSE (s_suppkey % 100) / 200::DOUBLE * 999 END::DOUBLE AS x0, CASE k WHEN 0 THEN 40 ELSE 999 END::DOUBLE AS y1 FROM supplier, range(2) t(k)")
def f24_boxes_in_answers(spark, sf_dir):
    k = (F.col("s_suppkey") % 100).cast("string")
    a = derive.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("answer_id"), F.concat(F.lit("It is at [10, 20, 30, 40], also px ["), k, F.lit(", 0, 150, 100].")).alias("answer"), F.lit(200.0).alias("width_px"), F.lit(100.0).alias("height_px"), F.lit(612.0).alias("width_pt"), F.lit(792.0).alias("height_pt"))
    return W.boxes_in_answer(a).select("answer_id", "ord", "frame", "x0", "y1")


@query(SEG + " SELECT id, CASE WHEN (x1 - x0) * (y1 - y0) > 0 THEN 0.5::DOUBLE END AS rect, 'triangle' AS what FROM segment WHERE greatest(x1 - x0, y1 - y0) > 0")
def p18_rectangularity(spark, sf_dir):
    s = derive.segments(spark, sf_dir).where("greatest(x1 - x0, y1 - y0) > 0")
    pt = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return s.select("id", F.round(rings.rectangularity(F.array(pt("x0", "y0"), pt("x1", "y0"), pt("x0", "y1"))), 9).alias("rect"), F.lit("triangle").alias("what"))


@query(SEG + " SELECT id FROM segment WHERE greatest(x1 - x0, y1 - y0) <= 50 AND (x1-x0)*(y1-y0)/2 / pow(x1 - x0 + y1 - y0 + sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)), 2) >= 0.02")
def p17_arrowheads(spark, sf_dir):
    s = derive.segments(spark, sf_dir)
    pt = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    r = s.select("id", F.array(pt("x0", "y0"), pt("x1", "y0"), pt("x0", "y1")).alias("vertices"), F.lit(True).alias("closed"))
    return rings.arrowheads(r, 200.0).select("id")


@query(SEG + " SELECT id, kind, layer, ax AS x, CASE WHEN id % 2 = 0 THEN 'c' || id END AS content FROM segment")
def k8_json_round_trip(spark, sf_dir):
    s = derive.segments(spark, sf_dir)
    pt = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    e = s.select("id", "kind", "layer", F.array(pt("ax", "ay"), pt("ex", "ey")).alias("vertices"), F.lit(False).alias("closed"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("c"), F.col("id").cast("string"))).alias("content"))
    return rings.from_json(rings.to_json(e)).select("id", "kind", "layer", F.col("vertices")[0]["x"].alias("x"), "content")


@query(PNT + ", p AS (SELECT DISTINCT a.sheet, a.x, a.y, round_even((b.x + 7 - a.x) / 2, 0) AS bx, round_even((b.y - 3 - a.y) / 2, 0) AS by_ FROM point a JOIN point b ON a.sheet = b.sheet AND sqrt((b.x+7-a.x)*(b.x+7-a.x)+(b.y-3-a.y)*(b.y-3-a.y)) <= 12), g AS (SELECT sheet, bx, by_, count(*) AS votes FROM p GROUP BY ALL), m AS (SELECT *, sum(votes) OVER w / count(*) OVER w AS mean, count(*) OVER w AS n_bins FROM g WINDOW w AS (PARTITION BY sheet)) SELECT sheet, bx::BIGINT AS bx, by_::BIGINT AS \"by\", votes, votes > mean AND ln(n_bins) + votes - mean - votes * ln(votes / mean) < ln(1e-6) AS significant FROM m QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY votes DESC, bx, by_) = 1")
def j24_a24_offset_votes(spark, sf_dir):
    p = derive.points(spark, sf_dir)
    a = p.select("sheet", F.col("x").alias("lx"), F.col("y").alias("ly"))
    e = p.select("sheet", (F.col("x") + 7).alias("rx"), (F.col("y") - 3).alias("ry"))
    return A.offset_votes(a, e, 12.0, keys=["sheet"]).select("sheet", "bx", "by", "votes", "significant")


@query("WITH s AS (SELECT ['circle', 'square', 'triangle'][p_size % 3 + 1] AS shape, p_size % 2 = 0 AS filled, p_size // 10 AS size, count(*) AS n FROM part GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY shape ORDER BY n DESC, filled, size)::INT AS rank FROM s QUALIFY rank <= 3")
def a19_o5_symbol_styles(spark, sf_dir):
    s = F.col("p_size")
    g = derive.table(spark, sf_dir, "part").select(F.element_at(F.array(*map(F.lit, ("circle", "square", "triangle"))), s % 3 + 1).alias("shape"), (s % 2 == 0).alias("filled"), F.floor(s / 10).alias("size"))
    return A.rank_by(g.groupBy("shape", "filled", "size").agg(F.count("*").alias("n")), ["shape"], [F.desc("n"), "filled", "size"], 3)


@query("SELECT p_brand AS doc_key, count(*) FILTER (p_partkey % 23 = 0) AS unread, count(*) FILTER (p_partkey % 23 <> 0) AS numbered FROM part GROUP BY 1")
def a18_status_counts(spark, sf_dir):
    return index(spark, sf_dir).groupBy("doc_key").agg(F.count_if(F.col("number").isNull()).alias("unread"), F.count("number").alias("numbered"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'layout' WHEN doc_id % 2 = 0 THEN 'ocr' ELSE 'pdf' END AS source, 'x' AS text FROM documents")
def s4_d1_ranked_sources(spark, sf_dir):
    d = derive.table(spark, sf_dir, "documents").select("doc_id")
    c = d.where("doc_id % 3 = 0").withColumn("source", F.lit("layout")).unionByName(d.where("doc_id % 2 = 0").withColumn("source", F.lit("ocr"))).unionByName(d.withColumn("source", F.lit("pdf")))
    return layout_json.ranked_text(c.withColumn("text", F.lit("x")), ["doc_id"], ["layout", "ocr", "pdf"])


@query("SELECT p_partkey, (j * 3 + i)::INT AS cell, 10.0::DOUBLE - j * 5 AS x, 20.0::DOUBLE + i * 4 AS y FROM part, range(3) a(i), range(2) b(j)")
def s16_grid_inserts(spark, sf_dir):
    p = derive.table(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).select("p_partkey", "i", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("j"))
    x, y = G.rotated(F.col("i") * 4.0, F.col("j") * 5.0, F.lit(90.0))
    return p.select("p_partkey", (F.col("j") * 3 + F.col("i")).alias("cell"), F.round(10 + x, 9).alias("x"), F.round(20 + y, 9).alias("y"))



@query(MARK + " SELECT 'model' AS space, count(*) AS n FROM markup WHERE turn % 2 = 0 UNION ALL SELECT 'paper', count(*) FROM markup WHERE turn % 2 = 1")
def u6_spaces(spark, sf_dir):
    m = derive.markups(spark, sf_dir)
    both = m.where("turn % 2 = 0").withColumn("space", F.lit("model")).unionByName(m.where("turn % 2 = 1").withColumn("space", F.lit("paper")))
    return both.groupBy("space").agg(F.count("*").alias("n"))


@query(SEG + " SELECT id AS arrow_id FROM segment WHERE id NOT IN (SELECT id FROM segment WHERE id % 4 = 0)")
def u3_unclaimed_arrows(spark, sf_dir):
    from folioscan.plans.constructs import without_claimed

    s = derive.segments(spark, sf_dir).select(F.col("id").alias("arrow_id"))
    return without_claimed(s, s.where("arrow_id % 4 = 0"))
