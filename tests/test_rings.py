import math
import random
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folioscan.operators import spatial_joins as J
from folioscan.plans import constructs as C
from folioscan.queries import load
from tests.oracle import compare
from tests.test_plans import plan_of

D = "/root/testdata/sf0.001"


def test_bubbles_keep_no_pair_of_all_in_reach(spark, monkeypatch):
    made = []
    real = J.points_in_rings

    def counted(*args, **more):
        made.append(real(*args, **more))
        return made[-1]

    for module in (J, C):
        monkeypatch.setattr(module, "points_in_rings", counted)
    df = load()[0]["x4_bubbles"](spark, D)
    # 500 circles and texts of three sheets, nearly all within reach of each other
    assert sum(x.count() for x in made) < 40_000
    # pairs on a ring are summed as they are met
    assert "distinct" not in plan_of(df).lower()


@pytest.mark.parametrize("ids", [lambda i: i - 3 if i % 50 == 3 else i, lambda i: i // 6 * 3 + i % 3])
def test_bubbles_of_repeated_ids_match_their_sql(spark, tmp_path, ids):
    shutil.copytree(D, tmp_path / "in", copy_function=shutil.copyfile)
    path = tmp_path / "in" / "embeddings.parquet"
    t = pq.read_table(path)
    at = t.schema.get_field_index("vec_id")
    pq.write_table(t.set_column(at, t.schema.field(at), pa.array(map(ids, t.column("vec_id").to_pylist()), t.schema.field(at).type)), path)
    queries, sql = load()
    compare(queries["x4_bubbles"](spark, str(tmp_path / "in")), sql["x4_bubbles"], str(tmp_path / "in"))


def test_rows_repeated_over_cells_are_not_broadcast(spark):
    left = spark.range(50).selectExpr("id l", "double(id) lx", "double(id) ly", "3.0D r")
    right = spark.range(50).selectExpr("id i", "double(id) rx", "double(id) ry")
    for df in (J.points_in_rings(left, right, F.col("r")), J.points_on_rings(left, right, F.col("r"), 0.2)):
        assert "SortMergeJoin" in plan_of(df) and "BroadcastHashJoin" not in plan_of(df)


def test_rings_match_brute_force(spark):
    r = random.Random(4)
    radii = [0.0, 0.5, 1.0, 3.0, 4.0, 7.5, 16.0, 40.0]
    a = [(i % 2, i, r.randrange(-40, 40) / 2, r.randrange(-40, 40) / 2, r.choice(radii)) for i in range(200)]
    b = [(i % 2, i, r.randrange(-60, 60) / 2, r.randrange(-60, 60) / 2) for i in range(150)]
    left = spark.createDataFrame(a, "k int, l long, lx double, ly double, r double")
    right = spark.createDataFrame(b, "k int, i long, rx double, ry double")
    dist = lambda p, q: math.sqrt((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2)
    got = [(x.l, x.i) for x in J.points_on_rings(left, right, F.col("r"), 0.2, ["k"]).collect()]
    want = [(p[1], q[1]) for p in a for q in b if p[0] == q[0] and abs(dist(p, q) - p[4]) <= 0.2 * p[4]]
    assert len(want) > 500 and sorted(got) == sorted(want)
    near = {}
    for p in a:
        most = max(q[4] for q in a if (q[0], q[2], q[3]) == (p[0], p[2], p[3]))
        if found := [(dist(p, q), q[1]) for q in b if p[0] == q[0] and dist(p, q) <= most]:
            near[p[0], p[2], p[3]] = min(found)
    got = J.nearest_in_rings(left, right, F.col("r"), ["k"], F.col("i")).collect()
    assert len(got) == len(near) and {(x.k, x.lx, x.ly): (x.near.dist, x.near.tie) for x in got} == near
