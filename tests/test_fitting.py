import math
import random

from folioscan.operators import fitting as P


def brute_snap(rows, tol):
    leaders, out = [], {}
    for sheet, i, ax, ay, ex, ey in sorted(rows, key=lambda r: r[1]):
        for which, (x, y) in enumerate(((ax, ay), (ex, ey))):
            near = [k for k, (s, lx, ly, _) in enumerate(leaders) if s == sheet and math.hypot(lx - x, ly - y) <= tol]
            if near:
                leaders[near[0]][3].append((i, which, x, y))
            else:
                leaders.append((sheet, x, y, [(i, which, x, y)]))
    for _, _, _, members in leaders:
        cx, cy = (sum(m[k] for m in members) / len(members) for k in (2, 3))
        out |= {(i, w): (round(cx, 9), round(cy, 9)) for i, w, _, _ in members}
    return out


def test_ends_snap_to_the_first_leader(spark):
    rng = random.Random(4)
    rows = [(i % 2, i, *(float(rng.randrange(0, 40)) for _ in range(4))) for i in range(90)]
    df = spark.createDataFrame(rows, "sheet int, id long, ax double, ay double, ex double, ey double")
    got = {(r.id, r.which): (round(r.x, 9), round(r.y, 9)) for r in P.snapped_ends(df, ["sheet"], 3.0).collect()}
    assert got == brute_snap(rows, 3.0)
    assert P.snapped_ends(df.limit(0), ["sheet"], 3.0).count() == 0


def test_snapping_matches_brute_force_on_the_driver_table(spark):
    from folioscan import derive
    from folioscan.queries.fitting import a26_snapped_ends

    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in derive.segments(spark, d).select("sheet", "id", "ax", "ay", "ex", "ey").collect()]
    got = {(r.id, r.which): (round(r.x, 9), round(r.y, 9)) for r in a26_snapped_ends(spark, d).collect()}
    assert got == brute_snap(rows, 6.0)


def test_facts_axes_and_calibration(spark):
    s = spark.createDataFrame([("d", 1, "A", 0.0, 0.0, 30.0, 0.2), ("d", 1, "", 5.0, 0.0, 5.0, 50.0), ("d", 1, None, 0.0, 0.0, 9.0, 0.0)], "doc_key string, page int, layer string, ax double, ay double, ex double, ey double")
    (f,) = P.drawing_facts(s, ["doc_key", "page"]).collect()
    assert (f.n_paths, f.ruling_h, f.ruling_v, f.layers) == (3, 1, 1, ["A"])
    p = spark.createDataFrame([(1, 0.0, 0.0), (1, 2.0, 2.0), (1, 4.0, 4.0), (2, 3.0, 3.0), (3, 0.0, 0.0), (3, 0.0, 5.0)], "g int, x double, y double")
    got = {r.g: (round(r.dx, 6), round(r.dy, 6)) for r in P.principal_axes(p, ["g"]).collect()}
    assert got == {1: (0.707107, 0.707107), 2: (1.0, 0.0), 3: (0.0, 1.0)}
    row = spark.createDataFrame([(0.0, 0.0, 3.0, 4.0, 10.0), (1.0, 1.0, 1.0, 1.0, 10.0), (0.0, 0.0, 1.0, 0.0, 0.0)], "a double, b double, c double, d double, r double")
    assert [r[0] for r in row.select(P.calibrated(row.a, row.b, row.c, row.d, row.r)).collect()] == [2.0, None, None]
