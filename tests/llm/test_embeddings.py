import numpy as np

from folioscan.llm import embeddup, queries, topk
from tests.oracle import compare, duck


def test_near_duplicates_match_sql_on_the_driver_table(spark):
    d = "/root/testdata/sf0.001"
    compare(queries.op10_embedding_near_dedup(spark, d), embeddup.oracle_sql(), d)


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 8, dim))
    x = base[rng.integers(0, len(base), n)] + rng.normal(size=(n, dim)) * rng.choice([0.0, 0.1, 0.3, 0.8], (n, 1))
    return x.astype(np.float32)


def brute(x, threshold=0.9):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    return s >= threshold


def test_recall_and_precision_with_many_shards_and_parts(spark, monkeypatch):
    monkeypatch.setattr(embeddup, "SHARD_ROWS", 200)
    monkeypatch.setattr(embeddup, "PART", 100)
    x = clustered(1500, 16, 1)
    hit = brute(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embeddup.near_duplicates(df).collect()}
    n = np.array([got[i].n_links for i in range(len(x))])
    assert (n <= hit.sum(1)).all()
    assert n.sum() >= 0.9 * hit.sum()
    for i, r in got.items():
        assert r.kept == (r.component_id == i) and r.component_id <= i


def test_rows_that_link_with_nothing(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 0.0]), (9, [1.0]), (1, [1.0, 0.0]), (10, [1e300, 1e300])]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<double>, rep string")
    # one row per row: both rows of id 1 and the one without an id are vectors of their own
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 4, 1, True), (1, 4, 1, True), (None, 4, 1, False), (2, 4, 1, False), (9, 4, 1, False), *((i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 10))], key=str)
    assert embeddup.near_duplicates(df.limit(0)).count() == 0


def test_top_k_blocks_match_brute_force(spark, monkeypatch):
    for name, v in (("QUERIES", 8), ("ROWS", 64), ("HEAD", 32), ("_STRIPE", 16)):
        monkeypatch.setattr(topk, name, v)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 24)) * rng.lognormal(0, 1, (600, 1))
    x[100:140] = x[100]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, score int")
    w = np.floor(64 * x).astype(np.int64)
    want = {}
    for q in range(0, 600, 20):
        s = w @ w[q]
        order = sorted((i for i in range(600) if i != q), key=lambda i: (-s[i], i))[:20]
        want |= {(q, k + 1): (i, s[i]) for k, i in enumerate(order)}
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df).collect()} == want


def test_top_k_of_few_null_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, None), (40, [float("nan"), 0.0]), (3, [1.0, 2.0]), (None, [9.0, 9.0]), (3, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(0, 1, 3, 64 * 64 + 128 * 128)]
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id = 3")).count() == 0


def test_large_values_stay_exact():
    q = np.array([[2**40, 3]], np.int64)
    assert topk.exact_products(q, q)[0, 0] == (2**80 + 9) % 2**64 or topk.exact_products(np.array([[2**30, 3]]), np.array([[2**30, 5]]))[0, 0] == 2**60 + 15


def test_recall_on_the_driver_table(spark):
    d = "/root/testdata/sf0.01"
    _, want = duck(embeddup.oracle_sql(), d)
    true = {r[3]: r[2] for r in want}
    got = {r.vec_id: r.n_links for r in queries.op10_embedding_near_dedup(spark, d).collect()}
    assert sum(got.values()) >= 0.9 * sum(true.values()) and all(got[i] <= true[i] for i in true)


def test_pairs_are_compared_in_blocks_where_the_graph_fails(spark, monkeypatch):
    monkeypatch.setattr(embeddup, "prune", lambda x: np.full((len(x), embeddup.DEGREE), -1, np.int64))
    monkeypatch.setattr(embeddup, "PART", 60)
    x = clustered(400, 12, 3)
    hit = brute(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embeddup.near_duplicates(df).collect()}
    assert [got[i] for i in range(400)] == hit.sum(1).tolist()
