"""Hand-made scenes with their truth, refusals and nulls."""

import math

import pytest
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.functions import units as U
from folioscan.operators import ordered as O
from folioscan.operators import slices as S
from folioscan.operators import spatial as A
from folioscan.operators import spatial_joins as J
from folioscan.plans import constructs as C
from folioscan.plans import markups as M
from folioscan.plans import pagemap as P
from folioscan.plans import roles as R
from folioscan.plans import scales as L
from folioscan.plans import sheets as H


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_grid_spacing_is_known(spark):
    pts = [("g", i * 3 + j, 10.0 * i, 10.0 * j) for i in range(3) for j in range(3)]
    df = spark.createDataFrame(pts, "cls string, pid long, x double, y double")
    r = A.spacing(df, ["cls"], 50.0).first()
    assert r.nn_mean == 10 and r.nn_std == 0 and r.hull_area == 400 and r.density_equivalent == pytest.approx(6.667, abs=1e-3)
    assert r.r > 2 and r.pattern == "regular" and not r.hull_may_overstate_area
    two = A.spacing(df.where("pid < 2"), ["cls"], 50.0).first()
    assert two.nn_mean == 10 and two.density_equivalent is None and two.pattern is None


def test_points_and_boxes_pair_once(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 19.9, 0.0)], "a int, lx double, ly double")
    right = spark.createDataFrame([(1, 10.0, 0.0), (2, -10.0, 0.0), (3, 0.0, 10.01)], "b int, rx double, ry double")
    assert sorted((r.a, r.b) for r in J.points_within(left, right, 10.0).collect()) == [(1, 1), (1, 2), (2, 1)]
    box = lambda p, rows: spark.createDataFrame(rows, ", ".join([f"{p}id int"] + [f"{p}{c} double" for c in ("x0", "y0", "x1", "y1")]))
    a, b = box("l", [(1, 0.0, 0.0, 35.0, 35.0)]), box("r", [(1, 5.0, 5.0, 34.0, 34.0), (2, 30.0, 30.0, 60.0, 60.0), (3, 36.0, 0.0, 40.0, 5.0)])
    assert sorted(r.rid for r in J.boxes_meeting(a, b, 10.0).collect()) == [1, 2]
    assert [r.rid for r in J.boxes_meeting(a, b, 10.0, test="contain").collect()] == [1]


def test_greedy_pairs_take_the_closest_first(spark):
    rows = [(1, 1, 1.0), (1, 2, 2.0), (2, 1, 1.5), (2, 2, 9.0), (3, 2, 3.0)]
    df = spark.createDataFrame(rows, "l int, r int, dist double")
    assert sorted((r.l, r.r) for r in J.greedy_pairs(df, [], "l", "r").collect()) == [(1, 1), (3, 2)]
    assert J.greedy_pairs(df.limit(0), [], "l", "r").count() == 0


def test_nearest_widens_until_it_finds(spark):
    left = spark.createDataFrame([("k", 1, 0.0, 0.0), ("k", 2, 500.0, 0.0)], "k string, i int, lx double, ly double")
    right = spark.createDataFrame([("k", j, 3.0 * j, 0.0) for j in range(1, 5)] + [("k", 9, 430.0, 0.0)], "k string, j int, rx double, ry double")
    got = sorted((r.i, r.rank, r.j) for r in J.nearest(left, right, 2, ["k"], "i", "j", 10.0, 100.0).collect())
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 9)]


def test_mirrored_controls_are_told(spark):
    pts = [(0.0, 0.0), (100.0, 0.0), (0.0, 80.0), (60.0, 40.0)]
    right = [("r", x, y, 10 + 2 * x, 20 - 2 * y) for x, y in pts]
    mirror = [("m", x, y, 10 - 2 * x, 20 - 2 * y) for x, y in pts]
    df = spark.createDataFrame(right + mirror, "s string, px double, py double, easting double, northing double")
    fits = {r.s: r for r in A.similarity_fit(df, ["s"]).collect()}
    assert not fits["r"].mirrored and fits["r"].rms == pytest.approx(0, abs=1e-6) and fits["r"].scale == pytest.approx(2)
    assert fits["m"].mirrored and fits["m"].rms_mirror == pytest.approx(0, abs=1e-5)


def test_scale_fits_and_refusals(spark):
    runs = [("ok", float(i), 3.0 * i) for i in range(6)] + [("drop", float(i), 35.0 if i == 3 else 10.0 * i) for i in range(7)] + [("few", 1.0, 1.0), ("few", 2.0, 2.0)]
    runs += [("zig", float(i), float((i * 7) % 10)) for i in range(9)]
    df = spark.createDataFrame(runs, "run string, pos double, value double")
    got = {r.run: r for r in O.fit_scales(df, ["run"], "pos", "value").collect()}
    assert got["ok"].slope == pytest.approx(3) and got["ok"].refusal is None
    assert got["drop"].slope == pytest.approx(10) and got["drop"].dropped == 1
    assert got["few"].refusal == "too few labels" and got["few"].slope is None
    assert got["zig"].refusal is not None


def test_null_is_not_zero(spark):
    assert one(spark, U.combine_confidence(F.lit(None).cast("double"), F.lit(None).cast("double"))) == 0.0
    assert one(spark, U.combine_confidence(F.lit(0.9), F.lit(None).cast("double"), F.lit(0.55))) == 0.55
    assert one(spark, U.convert_length(F.lit(3.0), F.lit("pt"), F.lit("ft"))) is None
    assert one(spark, U.parse_number(F.lit("1/0"))) is None and one(spark, U.parse_number(F.lit("1 1/2"))) == 1.5
    assert one(spark, U.parse_ratio(F.lit(" "))) is None and one(spark, U.parse_ratio(F.lit("as noted"))) is None
    r = one(spark, U.parse_ratio(F.lit("SCALE: 1-1/2\" = 1'-0\"")))
    assert (r.page_len, r.page_unit, r.real_len, r.real_unit) == (1.5, "in", 1.0, "ft")
    assert one(spark, U.magnification(U.parse_ratio(F.lit('1/8" = 1\'-0"')))) == pytest.approx(96)
    with pytest.raises(Exception, match="non-zero"):
        one(spark, U.scaled(U.quantity(F.lit(1.0), F.lit("pt")), F.lit(0.0), F.lit("ft"), F.lit(1.0), F.lit(0.0)))


def test_text_rules(spark):
    assert one(spark, T.running_key(F.lit("ACME  Report | Page 12 | 4.5"))) == "acme report | page ##"
    assert one(spark, T.pdf_date(F.lit("D:20260825160934-04'00'"))) == "2026-08-25T16:09:34-04:00"
    assert one(spark, T.pdf_date(F.lit("yesterday"))) == "yesterday" and one(spark, T.pdf_date(F.lit(""))) is None
    assert one(spark, T.label_role(F.lit("silty SAND"))) == "boundary_Sand" and one(spark, T.label_role(F.lit("pump"))) is None
    assert one(spark, T.expand_range(F.lit("W-1"), F.lit("W-3"))) == ["W-1", "W-2", "W-3"] and one(spark, T.expand_range(F.lit("A"), F.lit("W-3"))) == ["A", "W-3"]
    assert one(spark, T.divider_title(F.lit("APPENDIX B"), F.lit(2), F.array(F.lit("x")))) == "APPENDIX B"
    assert one(spark, T.divider_title(F.lit("APPENDIX B"), F.lit(90), F.array(F.lit("x")))) is None
    assert one(spark, T.unmapped_share(F.lit(""))) == 0.0 and one(spark, T.unmapped_share(F.lit("a�"))) == 0.5


@pytest.mark.parametrize(
    ("value", "pm", "res", "want"),
    [(12.3456, 0.23, None, "12.3 +/- 0.3"), (12.3456, 0.12, None, "12.35 +/- 0.12"), (12.3456, None, None, "12.346"), (12.3456, 0.12, 0.5, "12.3 +/- 0.12"), (None, 0.1, None, None), (105.0, 14.0, None, "105 +/- 14")],
)
def test_values_are_never_finer_than_printed(spark, value, pm, res, want):
    lit = lambda v: F.lit(v).cast("double")
    assert one(spark, L.display_value(lit(value), lit(pm), lit(res))) == want


def test_angles_wrap_and_zero_length_is_kept(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.5), (2, 0.0, 0.0, 10.0, -0.5), (3, 0.0, 0.0, 0.0, 5.0)], "id int, ax double, ay double, ex double, ey double")
    assert sorted(r.id for r in S.by_angle(df, 175, 5).collect()) == [1, 2]
    assert S.nearest_to(df, 0, 9, 1).first()["id"] == 3
    with pytest.raises(ValueError):
        S.in_window(df, 0, 0, 1, 1, mode="touch")
    assert one(spark, S.text_matches(F.lit("a(b"), "A(B"))


def test_leader_pointing_backwards_is_capped(spark):
    shafts = spark.createDataFrame([(1, 0.0, 0.0, 50.0, 0.0), (2, 0.0, 100.0, 50.0, 100.0)], "id long, ax double, ay double, ex double, ey double")
    arrows = spark.createDataFrame([(1, 50.0, 0.0, 1.0, 0.0, 3.0), (2, 50.0, 100.0, -1.0, 0.0, 3.0)], "arrow_id long, x double, y double, dx double, dy double, scale double")
    texts = spark.createDataFrame([(7, -2.0, 0.0, "NOTE"), (8, -2.0, 100.0, "B")], "text_id long, x double, y double, text string")
    got = {r.arrow_id: r for r in C.leaders(arrows, shafts, texts, 5.0, 20.0).collect()}
    assert got[1].tip_x == 50 and got[1].text_id == 7 and got[1].confidence > 0.9 and got[1].direction == "forward"
    assert got[2].confidence == pytest.approx(0.45) and got[2].direction == "backward"


def test_four_valued_cross_references(spark):
    calls = spark.createDataFrame([("d", 0, v, s) for v, s in (("1", "A-1"), ("9", "A-1"), ("5", "A-1"), ("1", "A-7"), ("1", "A-2"))], "doc_key string, page int, view string, sheet string")
    index = spark.createDataFrame([("d", 1, "A-1"), ("d", 2, "A-2")], "doc_key string, page int, number string")
    views = spark.createDataFrame([("d", 1, "1")], "doc_key string, page int, view string")
    lone = spark.createDataFrame([("d", 1, "5")], "doc_key string, page int, mark string")
    none = spark.createDataFrame([], "doc_key string, page int")
    run = lambda unread: {(r.view, r.sheet): r.status for r in H.judge(calls, index, views, unread, lone).collect()}
    assert run(none) == {("1", "A-1"): "resolved", ("9", "A-1"): "unresolved", ("5", "A-1"): "cannot_tell", ("1", "A-7"): "not_in_document", ("1", "A-2"): "cannot_tell"}
    assert run(spark.createDataFrame([("d", 9)], "doc_key string, page int"))["1", "A-7"] == "cannot_tell"


def test_sections_nest_and_close(spark):
    titles = ["APPENDIX A", "APPENDIX B", "APPENDIX A", "APPENDIX B", "APPENDIX C", "APPENDIX D"]
    df = spark.createDataFrame([("d", 10 * i, t, 100) for i, t in enumerate(titles)], "doc_key string, page int, title string, n_pages int")
    got = sorted((r.first_page, r.last_page, r.level) for r in R.sections(df).collect())
    assert [g[2] for g in got] == [0, 0, 1, 1, 1, 1] and got[-1][:2] == (50, 99)


def test_blank_pages_without_lines_are_kept(spark):
    facts = spark.createDataFrame([("d", 0, 612.0, 792.0, 0, 0.0, 0, 0, 0, False), ("d", 1, 612.0, 792.0, 0, 0.9, 0, 0, 0, False)], "doc_key string, page int, width double, height double, n_vector_paths int, image_coverage double, ruling_h int, ruling_v int, n_cad_chars int, optical boolean")
    lines = spark.createDataFrame([], "doc_key string, page int, ord int, text string, y0 double, y1 double, size double")
    got = {r.page: r for r in P.page_summaries(lines, facts).collect()}
    assert got[0].kind == "blank" and got[1].kind == "scanned" and got[1].needs_ocr and got[0].heading is None
    assert P.with_segments(P.page_summaries(lines, facts)).count() == 2


def test_replies_aims_and_duplicates(spark):
    rows = [("d", 0, 1, None, "u", "see here", "Text", 0.0, 0.0, 10.0, 10.0, 105.0, 105.0, 0), ("d", 0, 2, 1, "v", "ok", "Text", 100.0, 100.0, 120.0, 120.0, 0.0, 0.0, 0), ("d", 0, 3, None, "u", "See  here", "Text", 1.0, 1.0, 11.0, 11.0, 500.0, 500.0, 0), ("d", 0, 4, None, "w", "x", "Text", 104.0, 104.0, 108.0, 108.0, 5.0, 5.0, 0)]
    df = spark.createDataFrame(rows, "doc_key string, page int, xref long, irt_xref long, author string, text string, kind string, x0 double, y0 double, x1 double, y1 double, tip_x double, tip_y double, turn long")
    assert {r.xref: r.target for r in M.aimed_at(df).collect()} == {1: 4, 4: 1}
    assert [(r.xref, r.duplicate_of) for r in M.duplicate_marks(df).collect()] == [(3, 1)]
    assert {r.xref: r.n_replies for r in M.threads(df).collect()} == {1: 1, 2: 0, 3: 0, 4: 0}


def test_hull_and_rectangle():
    ring = A.hull([(0, 0), (4, 0), (4, 3), (0, 3), (2, 1), (4, 3)])
    assert A.area_of(ring) == 12 and A.tightest_rectangle(ring) == pytest.approx((12, 4, 3))
    assert A.hull([(1, 1), (1, 1)]) == [(1, 1)] and math.isclose(A.area_of([(0, 0), (1, 0)]), 0)


def test_dimension_with_witness_lines_and_text(spark):
    seg = [(1, 0.0, 0.0, 60.0, 0.0), (2, 0.0, -10.0, 0.0, 10.0), (3, 60.0, -10.0, 60.0, 10.0), (4, 0.0, 50.0, 60.0, 50.0)]
    s = spark.createDataFrame([(*r, min(r[1], r[3]), min(r[2], r[4]), max(r[1], r[3]), max(r[2], r[4])) for r in seg], "id long, ax double, ay double, ex double, ey double, x0 double, y0 double, x1 double, y1 double")
    heads = [(1, 0.0, 0.0, -1.0), (2, 60.0, 0.0, 1.0), (3, 0.0, 50.0, -1.0), (4, 60.0, 50.0, 1.0)]
    arrows = spark.createDataFrame([(i, x, y, d, 0.0, 3.0) for i, x, y, d in heads], "arrow_id long, x double, y double, dx double, dy double, scale double")
    texts = spark.createDataFrame([(9, 30.0, 2.0, "5'-0\"")], "text_id long, x double, y double, text string")
    got = {r.shaft_id: r for r in C.dimensions(arrows, s, s, texts, 3.0, 20.0).collect()}
    assert set(got) == {1, 4} and got[1].n_witness == 2 and got[1].text == "5'-0\"" and got[1].length == 60
    assert got[1].confidence == pytest.approx(0.4 + 0.3 * 0.9 + 0.3) and got[4].confidence == pytest.approx(0.4)
    bare = {r.shaft_id: r.confidence for r in C.dimensions(arrows, s, s, texts.limit(0), 3.0, 20.0).collect()}
    assert bare[1] == pytest.approx(1.0) and bare[4] == pytest.approx(0.45)
