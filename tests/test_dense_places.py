import math
import random

import pytest
from pyspark.sql import functions as F

from folioscan.operators import spatial_joins as J
from folioscan.plans import constructs as C
from folioscan.plans import reading
from folioscan.queries import load

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["j32_near_text", "j4_text_anchored", "x2_j6_dimensions", "x1_leaders", "x5_a27_clouds"])
def test_no_place_is_paired_with_all_in_reach(spark, monkeypatch, name):
    made = []
    real = J.points_within

    def counted(*args, **more):
        made.append(real(*args, **more))
        return made[-1]

    for module in (J, C, reading):
        monkeypatch.setattr(module, "points_within", counted, raising=False)
    load()[0][name](spark, D).collect()
    # 500 entities of three sheets, nearly all within reach of each other
    assert sum(df.count() for df in made) < 40_000


def _points(n, side, seed):
    r = random.Random(seed)
    # many share a place
    return [(i % 2, i, float(r.randrange(side)) / 2, float(r.randrange(side)) / 2) for i in range(n)]


def test_nearest_and_counts_within_match_brute_force(spark):
    a, b = _points(150, 120, 1), _points(200, 40, 2)
    left = spark.createDataFrame(a, "k int, l long, lx double, ly double")
    right = spark.createDataFrame(b, "k int, r long, rx double, ry double")
    near, count = {}, {}
    for k, _, x, y in a:
        got = [(math.hypot(x - rx, y - ry), r) for kk, r, rx, ry in b if kk == k and math.hypot(x - rx, y - ry) <= 20]
        if got:
            near[k, x, y], count[k, x, y] = min(got), len(got)
    got = J.nearest_within(left, right, 20.0, ["k"], F.col("r")).collect()
    assert len(got) == len(near)
    assert {(r.k, r.lx, r.ly): (round(r.near.dist, 9), r.near.tie) for r in got} == {k: (round(d, 9), i) for k, (d, i) in near.items()}
    got = J.count_within(left, right, 20.0, ["k"]).collect()
    assert {(r.k, r.lx, r.ly): r.n for r in got} == count and len(got) == len(count)


@pytest.mark.parametrize("radii", [(40.0, 40.0), (20.0, 60.0), (1.0, 40.0)])
def test_clouds_of_scattered_arcs_match_brute_force(spark, radii):
    r = random.Random(3)
    arcs = []
    for i in range(160):
        x, y = r.uniform(0, 400), r.uniform(0, 400)
        arcs.append((i % 2, i, x, y, x + r.uniform(-9, 9), y + r.uniform(-9, 9), r.uniform(*radii)))
    root = list(range(len(arcs)))
    links = []
    for p in arcs:
        for q in arcs:
            tol = 0.25 * (p[6] + q[6]) / 2
            if p[0] == q[0] and any(math.dist(e, f) <= tol for e in (p[2:4], p[4:6]) for f in (q[2:4], q[4:6])):
                links.append((p[1], q[1]))
    before = None
    while before != root:
        before = root[:]
        for u, v in links:
            root[u] = min(root[u], root[v])
    want = {}
    for i in root:
        want[i] = want.get(i, 0) + 1
    df = spark.createDataFrame(arcs, "k int, id long, ax double, ay double, ex double, ey double, radius double")
    df = df.withColumns({"x0": F.least("ax", "ex"), "y0": F.least("ay", "ey"), "x1": F.greatest("ax", "ex"), "y1": F.greatest("ay", "ey")})
    got = {r.cloud: r.n_arcs for r in C.clouds(df, 1, ["k"]).collect()}
    assert len(want) > 5 and got == want
