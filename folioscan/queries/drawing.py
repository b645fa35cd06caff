"""Queries of drawing geometry over derived segments, boxes and points."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan import derive
from folioscan.functions import geometry as G
from folioscan.operators import slices as S
from folioscan.operators import spatial as A
from folioscan.operators import spatial_joins as J
from folioscan.registry import query

SEG, PNT = derive.with_sql("segment"), derive.with_sql("point")


@query(SEG + " SELECT id, kind, layer FROM segment WHERE x0 <= 100 AND x1 >= -50 AND y0 <= 100 AND y1 >= -50 AND kind = 'line'")
def p1_window_intersect(spark, sf_dir):
    return S.in_window(derive.segments(spark, sf_dir), 100, -50, -50, 100, kind="line").select("id", "kind", "layer")


@query(SEG + " SELECT id FROM segment WHERE x0 >= -50 AND x1 <= 100 AND y0 >= -50 AND y1 <= 100")
def p1_window_contain(spark, sf_dir):
    return S.in_window(derive.segments(spark, sf_dir), -50, -50, 100, 100, mode="contain").select("id")


@query(SEG + " SELECT id, layer, color FROM segment WHERE layer = 'L3' AND lower(color) = '#ff0000'")
def p2_layer_and_color(spark, sf_dir):
    return S.by_color(S.on_layer(derive.segments(spark, sf_dir), "L3"), "#Ff0000").select("id", "layer", "color")


_ANGLE = "CASE WHEN (degrees(atan2(ey - ay, ex - ax)) % 180 + 180) % 180 >= 180 THEN 0 ELSE (degrees(atan2(ey - ay, ex - ax)) % 180 + 180) % 180 END"


@query(SEG + f" SELECT id, round({_ANGLE}, 6) AS angle FROM segment WHERE {_ANGLE} >= 170 OR {_ANGLE} <= 10")
def p3_near_horizontal(spark, sf_dir):
    return S.by_angle(derive.segments(spark, sf_dir), 170, 10).select("id", F.round("angle", 6).alias("angle"))


@query(SEG + " SELECT id, sqrt((ex-ax)*(ex-ax)+(ey-ay)*(ey-ay)) + sqrt((ax+10-ex)*(ax+10-ex)+(ay-ey)*(ay-ey)) AS length FROM segment WHERE sqrt((ex-ax)*(ex-ax)+(ey-ay)*(ey-ay)) + sqrt((ax+10-ex)*(ax+10-ex)+(ay-ey)*(ay-ey)) >= 250")
def p4_long_polylines(spark, sf_dir):
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    s = derive.segments(spark, sf_dir).withColumn("vertices", F.array(pt(F.col("ax"), F.col("ay")), pt(F.col("ex"), F.col("ey")), pt(F.col("ax") + 10, F.col("ay"))))
    return S.longer_than(s.withColumn("closed", F.lit(False)), 250).select("id", "length")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)tion[a-z]+ the')")
def p5_text_regex(spark, sf_dir):
    return derive.table(spark, sf_dir, "documents").where(S.text_matches(F.col("text"), "TION[a-z]+ the")).select("doc_id")


@query("SELECT * FROM (VALUES (17, 0), (3, 1), (17, 2), (250, 3)) t(id, place)")
def p6_lookup(spark, sf_dir):
    return S.lookup(derive.segments(spark, sf_dir), [17, 3, 17, 250, 10**9]).select("id", "place")




@query(
    SEG
    + """, e AS (SELECT id, 0 AS which, ax AS rx, ay AS ry FROM segment UNION ALL SELECT id, 1, ex, ey FROM segment)
SELECT p.id, e.id AS other, e.which, sqrt((p.ax-e.rx)*(p.ax-e.rx)+(p.ay-e.ry)*(p.ay-e.ry)) AS dist FROM segment p JOIN e ON p.id <> e.id
WHERE sqrt((p.ax-e.rx)*(p.ax-e.rx)+(p.ay-e.ry)*(p.ay-e.ry)) <= 20"""
)
def j1_ending_near(spark, sf_dir):
    s = derive.segments(spark, sf_dir)
    left = s.select("id", F.col("ax").alias("lx"), F.col("ay").alias("ly"))
    ends = S.ends(s).select(F.col("id").alias("other"), "which", "rx", "ry")
    return J.points_within(left, ends, 20.0).where("id <> other").select("id", "other", "which", "dist")


_SEG_T = "least(greatest(((5-ax)*(ex-ax)+(5-ay)*(ey-ay))/((ex-ax)*(ex-ax)+(ey-ay)*(ey-ay)),0),1)"


@query(SEG + f", d AS (SELECT id, {_SEG_T} AS t, ax, ay, ex, ey FROM segment) SELECT id, sqrt((5-(ax+t*(ex-ax)))*(5-(ax+t*(ex-ax)))+(5-(ay+t*(ey-ay)))*(5-(ay+t*(ey-ay)))) AS dist FROM d ORDER BY dist, id LIMIT 5")
def j2_nearest_segments(spark, sf_dir):
    return S.nearest_to(derive.segments(spark, sf_dir), 5, 5, 5).select("id", "dist")


@query(
    PNT
    + """, d AS (SELECT a.pid, b.pid AS other, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS dist FROM point a JOIN point b ON a.cls = b.cls AND a.pid <> b.pid),
r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY dist, other)::INT AS rank FROM d WHERE dist <= 160) SELECT * FROM r WHERE rank <= 3"""
)
def j2_three_nearest_of_class(spark, sf_dir):
    p = derive.points(spark, sf_dir)
    left = p.select("cls", "pid", F.col("x").alias("lx"), F.col("y").alias("ly"))
    # a point must find three besides itself
    right = p.select("cls", F.col("pid").alias("other"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = J.nearest(left, right, 4, ["cls"], "pid", "other", 40.0, 160.0).where("pid <> other")
    return A.rank_by(near.drop("rank"), ["pid"], ["dist", "other"], 3).select("pid", "other", "dist", "rank")


@query(
    SEG
    + """, t AS (SELECT id AS tid, (ax+ex)/2 AS x, (ay+ey)/2 AS y FROM segment WHERE kind = 'polyline')
SELECT s.id, tid, sqrt((s.ax-x)*(s.ax-x)+(s.ay-y)*(s.ay-y)) AS dist FROM segment s JOIN t ON sqrt((s.ax-x)*(s.ax-x)+(s.ay-y)*(s.ay-y)) <= 15 WHERE kind = 'line'"""
)
def j3_text_near(spark, sf_dir):
    s = derive.segments(spark, sf_dir)
    marks = s.where("kind = 'line'").select("id", F.col("ax").alias("lx"), F.col("ay").alias("ly"))
    texts = s.where("kind = 'polyline'").select(F.col("id").alias("tid"), ((F.col("ax") + F.col("ex")) / 2).alias("rx"), ((F.col("ay") + F.col("ey")) / 2).alias("ry"))
    return J.points_within(marks, texts, 15.0).select("id", "tid", "dist")


@query(
    SEG
    + """, t AS (SELECT id AS tid, (ax+ex)/2 AS x, (ay+ey)/2 AS y FROM segment WHERE kind = 'polyline'),
e AS (SELECT id, ax AS rx, ay AS ry, ex AS ox, ey AS oy FROM segment WHERE kind = 'line' UNION ALL SELECT id, ex, ey, ax, ay FROM segment WHERE kind = 'line'),
d AS (SELECT tid, id, ox, oy, sqrt((x-rx)*(x-rx)+(y-ry)*(y-ry)) AS dist FROM t JOIN e ON sqrt((x-rx)*(x-rx)+(y-ry)*(y-ry)) <= 30),
b AS (SELECT tid, min((dist, id, ox, oy)) AS m, count(*) AS n_found FROM d GROUP BY tid)
SELECT t.tid, m[2] AS id, m[3] AS points_at_x, m[4] AS points_at_y, coalesce(n_found, 0) AS n_found FROM t LEFT JOIN b USING (tid)"""
)
def j4_text_anchored(spark, sf_dir):
    s = derive.segments(spark, sf_dir)
    texts = s.where("kind = 'polyline'").select(F.col("id").alias("tid"), ((F.col("ax") + F.col("ex")) / 2).alias("lx"), ((F.col("ay") + F.col("ey")) / 2).alias("ly"))
    ends = S.ends(s.where("kind = 'line'"))
    best = J.nearest_within(texts, ends, 30.0, [], F.struct("id", "ox", "oy"))
    out = texts.join(best, ["lx", "ly"], "left").join(J.count_within(texts, ends, 30.0), ["lx", "ly"], "left")
    m = F.col("near.tie")
    return out.select("tid", m["id"].alias("id"), m["ox"].alias("points_at_x"), m["oy"].alias("points_at_y"), F.coalesce("n", F.lit(0)).alias("n_found"))


@query(
    SEG
    + """ SELECT a.id AS outer_id, count(*) AS n_inside FROM segment a JOIN segment b ON a.id <> b.id
WHERE a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1 AND a.kind = 'polyline' GROUP BY a.id"""
)
def j8_boxes_inside(spark, sf_dir):
    s = derive.segments(spark, sf_dir)
    outer = s.where("kind = 'polyline'").select(F.col("id").alias("outer_id"), *(F.col(c).alias("l" + c) for c in ("x0", "y0", "x1", "y1")))
    inner = s.select(F.col("id").alias("inner_id"), *(F.col(c).alias("r" + c) for c in ("x0", "y0", "x1", "y1")))
    hits = J.boxes_meeting(outer, inner, 100.0, test="contain").where("outer_id <> inner_id")
    return hits.groupBy("outer_id").agg(F.count("*").alias("n_inside"))


_W = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0)"
_H = "greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"
_AREA = "({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0)"


@query(
    SEG
    + f""", p AS (SELECT a.id, b.id AS other, {_W} * {_H} AS i, {_AREA.format("a")} AS aa, {_AREA.format("b")} AS ab FROM segment a JOIN segment b ON a.id < b.id AND a.layer = b.layer
  AND a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0)
SELECT id, other, i / (aa + ab - i) AS iou, i / least(aa, ab) AS of_smaller FROM p WHERE i / least(aa, ab) > 0.5 AND aa + ab > i AND least(aa, ab) > 0"""
)
def g7_overlaps(spark, sf_dir):
    s = derive.segments(spark, sf_dir)
    left = s.select("layer", "id", *(F.col(c).alias("l" + c) for c in ("x0", "y0", "x1", "y1")))
    right = s.select("layer", F.col("id").alias("other"), *(F.col(c).alias("r" + c) for c in ("x0", "y0", "x1", "y1")))
    hits = J.boxes_meeting(left, right, 100.0, ["layer"]).where("id < other")
    a, b = G.box("l"), G.box("r")
    return hits.select("id", "other", G.iou(a, b).alias("iou"), G.overlap_of_smaller(a, b).alias("of_smaller")).where("of_smaller > 0.5")


@query(
    SEG
    + """ SELECT p.id AS pid, arg_min(b.id, ((b.x1-b.x0)*(b.y1-b.y0), b.id)) AS viewport, count(*) AS n FROM segment p JOIN segment b
ON p.ax BETWEEN b.x0 AND b.x1 AND p.ay BETWEEN b.y0 AND b.y1 AND b.kind = 'polyline' AND p.id <> b.id GROUP BY p.id"""
)
def j14_viewport_of_point(spark, sf_dir):
    s = derive.segments(spark, sf_dir)
    points = s.select(F.col("id").alias("pid"), F.col("ax").alias("px"), F.col("ay").alias("py"))
    hits = J.points_in_boxes(points, s.where("kind = 'polyline'").select("id", "x0", "y0", "x1", "y1"), 100.0).where("pid <> id")
    return hits.groupBy("pid").agg(F.min_by("id", F.struct(G.area(G.box()), F.col("id"))).alias("viewport"), F.count("*").alias("n"))


@query(SEG + " SELECT kind AS key, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM segment GROUP BY kind")
def a1_counts_by_kind(spark, sf_dir):
    return S.counts(derive.segments(spark, sf_dir), "kind")


@query(SEG + " SELECT id, width, mid_y FROM (SELECT id, x1 - x0 AS width, (y0 + y1) / 2 AS mid_y FROM segment) ORDER BY width DESC, mid_y DESC, id LIMIT 1")
def x7_ground_surface(spark, sf_dir):
    return S.ground_surface(derive.segments(spark, sf_dir))


@query(
    PNT
    + """, d AS (SELECT a.cls, a.pid, b.pid AS other, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS dist FROM point a JOIN point b ON a.cls = b.cls AND a.pid <> b.pid)
SELECT cls, pid, min(dist) AS nn, arg_min(other, (dist, other)) AS nn_pid FROM d WHERE dist <= 200 GROUP BY cls, pid"""
)
def a10_nearest_neighbour(spark, sf_dir):
    return A.nearest_neighbour(derive.points(spark, sf_dir), ["cls"], 200.0)


@query(PNT + " SELECT CASE WHEN grouping(cls) = 0 THEN cls END AS cls, grouping(cls) = 1 AS whole, count(*) AS n, round(avg(x), 9) AS mean_x, round(avg(y), 9) AS mean_y, round(stddev_pop(x), 9) AS std_x FROM point GROUP BY GROUPING SETS ((), (cls))")
def a11_statistics_by_class(spark, sf_dir):
    got = A.by_class(derive.points(spark, sf_dir))
    return got.select("cls", "whole", "n", *(F.round(c, 9).alias(c) for c in ("mean_x", "mean_y", "std_x")))


@query()
def a10_spacing(spark, sf_dir):
    return A.spacing(derive.points(spark, sf_dir), ["cls"], 400.0)


@query()
def a12_spacing_candidates(spark, sf_dir):
    return A.spacing_candidates(A.spacing(derive.points(spark, sf_dir), ["cls"], 400.0), ["cls"])


@query()
def a14_hulls(spark, sf_dir):
    return A.hulls(derive.points(spark, sf_dir), ["cls"])


@query(
    PNT.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, l AS (SELECT a.pid AS a, b.pid AS b FROM point a JOIN point b ON a.cls = b.cls AND a.pid <> b.pid AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= 12),
reach(a, b) AS (SELECT pid, pid FROM point UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a), root AS (SELECT a AS pid, min(b) AS root FROM reach GROUP BY a),
g AS (SELECT cls, root, count(*) AS merged FROM point JOIN root USING (pid) GROUP BY ALL)
SELECT g.cls, root AS pid, p.x, p.y, merged FROM g JOIN point p ON p.pid = root"""
)
def a13_merge_coincident(spark, sf_dir):
    return A.merge_coincident(derive.points(spark, sf_dir), ["cls"], 12.0)




@query(PNT + ", f AS (SELECT cls, x AS px, y AS py, 1000 + 2 * x - y * 0.5::DOUBLE + (pid % 3) AS e, 500 + 0.5::DOUBLE * x + 2 * y AS h FROM point) SELECT cls, count(*)::DOUBLE AS n, round((covar_pop(px, e) + covar_pop(py, h)) / (var_pop(px) + var_pop(py)), 6) AS re, round((covar_pop(px, h) - covar_pop(py, e)) / (var_pop(px) + var_pop(py)), 6) AS im, false AS mirrored FROM f GROUP BY cls")
def a22_similarity_fit(spark, sf_dir):
    p = derive.points(spark, sf_dir)
    controls = p.select("cls", F.col("x").alias("px"), (-F.col("y")).alias("py"), (1000 + 2 * F.col("x") - 0.5 * F.col("y") + F.col("pid") % 3).alias("easting"), (500 + 0.5 * F.col("x") + 2 * F.col("y")).alias("northing"))
    return A.similarity_fit(controls, ["cls"]).select("cls", "n", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"), "mirrored")


@query(
    PNT
    + """, s AS (SELECT pid AS sid, sheet, x + 1 AS x, y FROM point),
tw AS (SELECT a.pid, min(b.pid) AS same_point FROM point a JOIN point b ON a.pid <> b.pid AND a.sheet = b.sheet AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= 2 GROUP BY a.pid),
o AS (SELECT a.pid, arg_min(sid, (sqrt((a.x-s.x)*(a.x-s.x)+(a.y-s.y)*(a.y-s.y)), sid)) AS on_symbol FROM point a JOIN s ON a.sheet = s.sheet AND sqrt((a.x-s.x)*(a.x-s.x)+(a.y-s.y)*(a.y-s.y)) <= 2 GROUP BY a.pid)
SELECT p.sheet, p.pid, same_point, on_symbol, CASE WHEN same_point IS NOT NULL THEN 'same point' WHEN on_symbol IS NULL THEN 'not on a symbol' ELSE 'ok' END AS flag
FROM point p LEFT JOIN tw USING (pid) LEFT JOIN o USING (pid)"""
)
def j16_plan_point_check(spark, sf_dir):
    p = derive.points(spark, sf_dir)
    return A.check_points(p, p.select("sheet", F.col("pid").alias("sid"), (F.col("x") + 1).alias("x"), "y"), 2.0, ["sheet"])


@query()
def j15_symbol_labels(spark, sf_dir):
    p = derive.points(spark, sf_dir)
    left = p.where("pid % 2 = 0").select("sheet", F.col("pid").alias("symbol"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    right = p.where("pid % 2 = 1").select("sheet", F.col("pid").alias("label"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    pairs = J.points_within(left, right, 30.0, ["sheet"]).select("sheet", "symbol", "label", "dist")
    return J.greedy_pairs(pairs, ["sheet"], "symbol", "label")


@query(SEG + " SELECT layer, id, sqrt((ex-ax)*(ex-ax)+(ey-ay)*(ey-ay)) AS length, row_number() OVER (PARTITION BY layer ORDER BY sqrt((ex-ax)*(ex-ax)+(ey-ay)*(ey-ay)) DESC, id)::INT AS rank FROM segment QUALIFY rank <= 3")
def o3_best_of_layer(spark, sf_dir):
    s = derive.segments(spark, sf_dir).withColumn("length", G.distance(*map(F.col, ("ax", "ay", "ex", "ey"))))
    return A.rank_by(s, ["layer"], [F.desc("length"), "id"], 3).select("layer", "id", "length", "rank")


@query(SEG + " SELECT id, round(ax * cos(radians(30::DOUBLE)) - ay * sin(radians(30::DOUBLE)), 6) AS rx, round(ax * sin(radians(30::DOUBLE)) + ay * cos(radians(30::DOUBLE)), 6) AS ry, 792 - ay AS dx, ax AS dy FROM segment")
def g6_g15_frames(spark, sf_dir):
    s = derive.segments(spark, sf_dir)
    rx, ry = G.rotated(F.col("ax"), F.col("ay"), F.lit(30.0))
    dx, dy = G.to_display(F.col("ax"), F.col("ay"), F.lit(90), F.lit(612.0), F.lit(792.0))
    return s.select("id", F.round(rx, 6).alias("rx"), F.round(ry, 6).alias("ry"), dx.alias("dx"), dy.alias("dy"))
