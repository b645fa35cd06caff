"""Nothing meets across pages."""

from folioscan.operators import spatial as A
from folioscan.operators.spatial_joins import points_in_rings
from folioscan.plans import constructs as C
from folioscan.plans import reading as R

KEYS = ["doc_key", "page"]


def test_leaders_stay_on_their_page(spark):
    arrows = spark.createDataFrame([("d", 1, 1, 10.0, 10.0, 1.0, 0.0, 1.0)], "doc_key string, page int, arrow_id long, x double, y double, dx double, dy double, scale double")
    shafts = spark.createDataFrame([("d", 2, 7, 0.0, 10.0, 10.0, 10.0), ("d", 1, 8, -20.0, 11.0, 11.0, 11.0)], "doc_key string, page int, id long, ax double, ay double, ex double, ey double")
    texts = spark.createDataFrame([("d", 2, 5, 0.0, 10.0, "note")], "doc_key string, page int, text_id long, x double, y double, text string")
    (got,) = C.leaders(arrows, shafts, texts, 3.0, 30.0, keys=KEYS).collect()
    assert (got.page, got.shaft_id, got.text_id) == (1, 8, None)
    # the other page's text does not make this a page with text
    assert abs(got.confidence - (0.45 + 0.20 * (1 - 2**0.5 / 3)) / 0.65) < 1e-9


def test_bubbles_have_their_pages_typical_size(spark):
    circles = spark.createDataFrame([("d", 1, 1, 0.0, 0.0, 10.0, 1.0), ("d", 2, 2, 0.0, 0.0, 400.0, 1.0)], "doc_key string, page int, circle_id long, x double, y double, radius double, roundness double")
    texts = spark.createDataFrame([("d", 1, 1, 0.0, 0.0, "A"), ("d", 2, 2, 0.0, 0.0, "B")], "doc_key string, page int, text_id long, x double, y double, text string")
    segments = spark.createDataFrame([("d", 2, 1, 10.0, 0.0, 50.0, 0.0)], "doc_key string, page int, id long, ax double, ay double, ex double, ey double")
    got = {r.page: r for r in C.bubbles(circles, texts, segments, keys=KEYS).collect()}
    assert {p: (r.text, r.n_attached, r.confidence) for p, r in got.items()} == {1: ("A", 0, 1.0), 2: ("B", 0, 1.0)}


def test_clouds_symbols_and_native_tips(spark):
    arcs = [("d", k % 2, k, 10.0 * k, 0.0, 10.0 * k + 10, 0.0, 10.0 * k, 0.0, 10.0 * k + 10, 5.0, 8.0) for k in range(6)]
    df = spark.createDataFrame(arcs, "doc_key string, page int, id long, ax double, ay double, ex double, ey double, x0 double, y0 double, x1 double, y1 double, radius double")
    assert C.clouds(df, 2, KEYS).count() == 0
    assert [r.n_arcs for r in C.clouds(df, 2).collect()] == [6]
    at = lambda rows, name: spark.createDataFrame(rows, f"doc_key string, page int, {name} long, x double, y double, size double")
    got = C.plan_symbols(at([("d", 1, 1, 0.0, 0.0, 100.0)], "symbol"), at([("d", 2, 1, 1.0, 0.0, 0.0), ("d", 1, 2, 250.0, 0.0, 0.0)], "label"), keys=KEYS).collect()
    assert [(r.symbol, r.label) for r in got] == [(1, 2)]  # 250 is within three sizes of 100
    tips = lambda rows: spark.createDataFrame(rows, "doc_key string, page int, id long, tip_x double, tip_y double, confidence double")
    got = C.with_native(tips([("d", 1, 1, 0.0, 0.0, 0.9)]), tips([("d", 2, 9, 0.0, 0.0, 1.0)]), 5.0, KEYS)
    assert {(r.id, r.superseded_by) for r in got.collect()} == {(1, None), (9, None)}


def test_points_votes_and_near_text(spark):
    p = spark.createDataFrame([("d", 1, 1, 0.0, 0.0), ("d", 2, 2, 0.5, 0.0)], "doc_key string, page int, pid long, x double, y double")
    s = p.selectExpr("doc_key", "page", "pid as sid", "x", "y")
    assert {(r.pid, r.same_point, r.flag) for r in A.check_points(p, s, 2.0, KEYS).collect()} == {(1, None, "ok"), (2, None, "ok")}
    a, e = p.selectExpr("doc_key", "page", "x as lx", "y as ly"), p.selectExpr("doc_key", "page", "x + 4 as rx", "y as ry")
    assert sorted((r.page, r.bx, r.votes) for r in A.offset_votes(a, e, 12.0, keys=KEYS).collect()) == [(1, 2, 1), (2, 2, 1)]
    t = p.selectExpr("doc_key", "page", "concat('t', pid) as text", "x", "y")
    assert {(r.id, r.near) for r in R.near_text(p.selectExpr("doc_key", "page", "pid as id", "x", "y"), t, 5.0, KEYS).collect()} == {(1, "t1"), (2, "t2")}


def test_merging_follows_distance_and_not_cells(spark):
    p = spark.createDataFrame([(0, 1, 0.995, 0.0), (0, 2, 1.005, 0.0), (0, 3, 1.5, 0.0), (0, 4, 9.0, 9.0), (1, 5, 1.0, 0.0)], "g int, pid long, x double, y double")
    got = {r.pid: (r.g, r.x, r.merged) for r in A.merge_coincident(p, ["g"], 0.6).collect()}
    assert got == {1: (0, 0.995, 3), 4: (0, 9.0, 1), 5: (1, 1.0, 1)}


def test_rings_of_any_size_are_met(spark):
    left = spark.createDataFrame([(i, float(i), 0.0, r) for i, r in enumerate([0.0, 0.001, 1.0, 30.0, 5000.0])], "l long, lx double, ly double, r double")
    right = spark.createDataFrame([(k, k * 7.0 - 3000, 0.0) for k in range(1000)], "k long, rx double, ry double")
    from pyspark.sql import functions as F

    got = {(x.l, x.k) for x in points_in_rings(left, right, F.col("r")).collect()}
    assert got == {(i, k) for i, r in enumerate([0.0, 0.001, 1.0, 30.0, 5000.0]) for k in range(1000) if abs(k * 7.0 - 3000 - i) <= r}
