"""Queries of composed constructs over derived segments and points."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan import derive
from folioscan.functions import text as T
from folioscan.plans import constructs as C
from folioscan.registry import query

SEG, PNT = derive.with_sql("segment"), derive.with_sql("point")


KEYS = ["sheet"]


def _texts(spark, sf_dir):
    p = derive.points(spark, sf_dir)
    return p.select("sheet", F.col("pid").alias("text_id"), "x", "y", F.concat(F.lit("K"), (F.col("pid") % 50).cast("string")).alias("text"))


_ARROW = "arrow AS (SELECT id AS arrow_id, sheet, ax + 1 AS x, ay AS y, 1.0::DOUBLE AS dx, 0.0::DOUBLE AS dy, 3.0::DOUBLE AS scale FROM segment)"
_TEXT = "txt AS (SELECT pid AS text_id, sheet, x, y, 'K' || (pid % 50) AS text FROM point)"


@query(
    SEG
    + ", "
    + derive.SQL["point"]
    + f""", {_ARROW}, {_TEXT}, ends AS (SELECT id AS shaft_id, sheet AS on_sheet, ax AS rx, ay AS ry, ex AS ox, ey AS oy FROM segment UNION ALL SELECT id, sheet, ex, ey, ax, ay FROM segment),
p AS (SELECT a.*, e.*, sqrt((a.x-rx)*(a.x-rx)+(a.y-ry)*(a.y-ry)) AS dist, sqrt((rx-ox)*(rx-ox)+(ry-oy)*(ry-oy)) AS length FROM arrow a JOIN ends e ON a.sheet = e.on_sheet AND sqrt((a.x-rx)*(a.x-rx)+(a.y-ry)*(a.y-ry)) <= 6),
q AS (SELECT *, ((rx-ox)*dx + (ry-oy)*dy) / length AS align FROM p WHERE length >= 2 * scale),
b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY arrow_id ORDER BY abs(align) DESC, dist, shaft_id, rx DESC, ry DESC) = 1),
n AS (SELECT arrow_id, min((sqrt((ox-t.x)*(ox-t.x)+(oy-t.y)*(oy-t.y)), t.text_id)) AS t FROM b JOIN txt t ON t.sheet = b.sheet AND sqrt((ox-t.x)*(ox-t.x)+(oy-t.y)*(oy-t.y)) <= 40 GROUP BY 1),
s AS (SELECT b.*, t[2] AS text_id, 0.45 * abs(align) + 0.35 * CASE WHEN t IS NOT NULL THEN 1 - t[1] / 40 ELSE 0 END + 0.20 * (1 - dist / 6) AS score FROM b LEFT JOIN n USING (arrow_id))
SELECT sheet, arrow_id, shaft_id, rx AS tip_x, ry AS tip_y, text_id, round(greatest(0, least(1, CASE WHEN align < 0 THEN least(score, 0.45) ELSE score END)), 9)::DOUBLE AS confidence, CASE WHEN align < 0 THEN 'backward' ELSE 'forward' END AS direction FROM s"""
)
def x1_leaders(spark, sf_dir):
    s = derive.segments(spark, sf_dir)
    arrows = s.select("sheet", F.col("id").alias("arrow_id"), (F.col("ax") + 1).alias("x"), F.col("ay").alias("y"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(3.0).alias("scale"))
    return C.leaders(arrows, s, _texts(spark, sf_dir), 6.0, 40.0, keys=KEYS).withColumn("confidence", F.round("confidence", 9))


@query(
    SEG
    + ", "
    + derive.SQL["point"]
    + f""", {_TEXT}, c AS (SELECT id AS circle_id, sheet, ax AS x, ay AS y, 10.0::DOUBLE + id % 31 AS radius FROM segment),
t AS (SELECT circle_id, min((sqrt((c.x-t.x)*(c.x-t.x)+(c.y-t.y)*(c.y-t.y)), text_id, text)) AS t FROM c JOIN txt t ON t.sheet = c.sheet AND sqrt((c.x-t.x)*(c.x-t.x)+(c.y-t.y)*(c.y-t.y)) <= 0.9 * radius WHERE length(text) <= 4 GROUP BY 1),
e AS (SELECT id, sheet, ax AS rx, ay AS ry FROM segment UNION ALL SELECT id, sheet, ex, ey FROM segment),
h AS (SELECT circle_id, count(DISTINCT id) AS n FROM c JOIN e ON c.sheet = e.sheet AND abs(sqrt((x-rx)*(x-rx)+(y-ry)*(y-ry)) - radius) <= 0.2 * radius GROUP BY 1), m AS (SELECT sheet, quantile_cont(radius, 0.5) AS typical FROM c GROUP BY sheet)
SELECT c.sheet, c.circle_id, t[2] AS text_id, t[3] AS text, coalesce(n, 0) AS n_attached, CASE coalesce(n, 0) WHEN 0 THEN 'keynote' WHEN 1 THEN 'grid' ELSE 'detail' END AS kind,
 round(0.35 * 0.9 + 0.45 * (1 - t[1] / (0.9 * radius)) + 0.20 * least(radius, typical) / greatest(radius, typical), 9)::DOUBLE AS confidence FROM c JOIN t USING (circle_id) LEFT JOIN h USING (circle_id) JOIN m ON m.sheet = c.sheet"""
)
def x4_bubbles(spark, sf_dir):
    s = derive.segments(spark, sf_dir)
    circles = s.select("sheet", F.col("id").alias("circle_id"), F.col("ax").alias("x"), F.col("ay").alias("y"), (10.0 + F.col("id") % 31).alias("radius"), F.lit(0.9).alias("roundness"))
    return C.bubbles(circles, _texts(spark, sf_dir), s, keys=KEYS).withColumn("confidence", F.round("confidence", 9))


@query(
    SEG
    + ", "
    + derive.SQL["point"]
    + f""", {_TEXT}, r AS (SELECT layer, id AS rect_id, x0 + 500 AS x0, y0 + 500 AS y0, x1 + 500 AS x1, y1 + 500 AS y1 FROM segment),
nt AS (SELECT layer, rect_id, count(*) AS n_text FROM r JOIN txt ON txt.x + 500 BETWEEN x0 AND x1 AND txt.y + 500 BETWEEN y0 AND y1 AND layer = 'L' || (text_id % 10) GROUP BY ALL),
nr AS (SELECT a.layer, a.rect_id, count(*) AS n_rect FROM r a JOIN r b ON a.layer = b.layer AND a.rect_id <> b.rect_id AND a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1 GROUP BY ALL),
s AS (SELECT layer, rect_id, coalesce(n_text, 0) AS n_text, coalesce(n_rect, 0) AS n_rect,
 round(0.35 * greatest(0, least(1, 1 - least((1200 - x1) / 1200, (1200 - y1) / 1200) / 0.4)) + 0.35 * least(coalesce(n_text, 0) / 8, 1) + 0.30 * least(coalesce(n_rect, 0) / 4, 1), 9)::DOUBLE AS confidence FROM r LEFT JOIN nt USING (layer, rect_id) LEFT JOIN nr USING (layer, rect_id))
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY layer ORDER BY confidence DESC, rect_id) <= 3"""
)
def x6_title_blocks(spark, sf_dir):
    s = derive.segments(spark, sf_dir)
    r = s.select("layer", F.col("id").alias("rect_id"), *((F.col(c) + 500).alias(c) for c in ("x0", "y0", "x1", "y1")), F.lit(1200.0).alias("width"), F.lit(1200.0).alias("height"))
    t = _texts(spark, sf_dir).select(F.concat(F.lit("L"), (F.col("text_id") % 10).cast("string")).alias("layer"), "text_id", (F.col("x") + 500).alias("x"), (F.col("y") + 500).alias("y"))
    return C.title_blocks(r, t, ["layer"]).drop("rank").withColumn("confidence", F.round("confidence", 9))


_NEAR = """(SELECT DISTINCT a.id AS a, b.id AS b FROM (SELECT id, sheet, ax AS x, ay AS y FROM segment UNION ALL SELECT id, sheet, ex, ey FROM segment) a
  JOIN (SELECT id, sheet, ax AS x, ay AS y FROM segment UNION ALL SELECT id, sheet, ex, ey FROM segment) b ON a.id <> b.id AND a.sheet = b.sheet AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= 10)"""


@query(
    SEG.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", l AS {_NEAR},
reach(a, b) AS (SELECT id, id FROM segment UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a), root AS (SELECT a AS id, min(b) AS cloud FROM reach GROUP BY a)
SELECT sheet, cloud, count(*) AS n_arcs, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, round(least(0.65, 0.35 + 0.03 * count(*)), 9)::DOUBLE AS confidence FROM segment JOIN root USING (id) GROUP BY sheet, cloud HAVING count(*) >= 3"""
)
def x5_a27_clouds(spark, sf_dir):
    arcs = derive.segments(spark, sf_dir).withColumn("radius", F.lit(40.0))
    return C.clouds(arcs, keys=KEYS).withColumn("confidence", F.round("confidence", 9))


@query()
def x26_plan_symbols(spark, sf_dir):
    p = derive.points(spark, sf_dir)
    return C.plan_symbols(p.where("pid % 2 = 0").select("sheet", F.col("pid").alias("symbol"), "x", "y", F.lit(8.0).alias("size")), p.where("pid % 2 = 1").select("sheet", F.col("pid").alias("label"), "x", "y"), keys=KEYS)


@query(SEG + " SELECT color, min(CASE WHEN kind = 'line' THEN 'boundary_Clay' ELSE 'surface' END) FILTER (id = m) AS role, min(dist) AS distance FROM (SELECT *, abs(ax) AS dist, arg_min(id, (abs(ax), CASE WHEN kind = 'line' THEN 'boundary_Clay' ELSE 'surface' END)) OVER (PARTITION BY color) AS m FROM segment) GROUP BY color")
def j10_color_roles(spark, sf_dir):
    s = derive.segments(spark, sf_dir)
    text = F.when(F.col("kind") == "line", "stiff CLAY").otherwise("Existing grade")
    return C.color_roles(s.select("color", T.label_role(text).alias("role"), F.abs("ax").alias("distance")))


@query(
    SEG
    + """, c AS (SELECT id, sheet, ax AS tip_x, ay AS tip_y, 0.8::DOUBLE AS confidence FROM segment WHERE id % 2 = 0), n AS (SELECT id, sheet, ax AS tip_x, ay AS tip_y FROM segment WHERE id % 2 = 1),
m AS (SELECT c.id, arg_min(n.id, (sqrt((c.tip_x-n.tip_x)*(c.tip_x-n.tip_x)+(c.tip_y-n.tip_y)*(c.tip_y-n.tip_y)), n.id)) AS superseded_by FROM c JOIN n ON c.sheet = n.sheet AND sqrt((c.tip_x-n.tip_x)*(c.tip_x-n.tip_x)+(c.tip_y-n.tip_y)*(c.tip_y-n.tip_y)) <= 10 GROUP BY 1)
SELECT c.sheet, c.id, CASE WHEN superseded_by IS NULL THEN 0.8 ELSE 0.25 END::DOUBLE AS confidence, superseded_by, 'composed' AS source FROM c LEFT JOIN m USING (id) UNION ALL SELECT sheet, id, 1.0::DOUBLE, NULL, 'native' FROM n"""
)
def u2_j25_native_and_composed(spark, sf_dir):
    s = derive.segments(spark, sf_dir).select("sheet", "id", F.col("ax").alias("tip_x"), F.col("ay").alias("tip_y"), F.lit(0.8).alias("confidence"))
    return C.with_native(s.where("id % 2 = 0"), s.where("id % 2 = 1"), 10.0, KEYS).drop("tip_x", "tip_y")


@query()
def j9_labels_of_regions(spark, sf_dir):
    s = derive.segments(spark, sf_dir)
    pt = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    regions = s.where("id % 3 = 0").select("layer", F.col("id").alias("region_id"), F.array(pt("x0", "y0"), pt("x1", "y0"), pt("x1", "y1"), pt("x0", "y1")).alias("vertices"), "x0", "y0", "x1", "y1")
    labels = s.where("id % 3 <> 0").select("layer", F.col("id").alias("label_id"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    return C.labels_of_regions(regions, labels, ["layer"])


@query()
def x2_j6_dimensions(spark, sf_dir):
    s = derive.segments(spark, sf_dir)
    head = lambda end, other, k: s.select("sheet", (F.col("id") * 2 + k).alias("arrow_id"), F.col(f"{end}x").alias("x"), F.col(f"{end}y").alias("y"), ((F.col(f"{end}x") - F.col(f"{other}x")) / F.col("n")).alias("dx"), ((F.col(f"{end}y") - F.col(f"{other}y")) / F.col("n")).alias("dy"), F.lit(3.0).alias("scale"))
    s = s.withColumn("n", F.greatest(F.sqrt((F.col("ex") - F.col("ax")) ** 2 + (F.col("ey") - F.col("ay")) ** 2), F.lit(1e-9)))
    return C.dimensions(head("a", "e", 0).unionByName(head("e", "a", 1)), s, s, _texts(spark, sf_dir), 4.0, 30.0, KEYS)
