import numpy as np
import pytest
import xxhash

from folioscan.llm import simhash


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius=4):
    ids = sorted(fps)
    comp = {i: i for i in ids}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    arr = np.array([fps[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        d = np.bitwise_count(arr[k + 1 :] ^ arr[k])
        for j in np.flatnonzero(d <= radius):
            a, b = sorted((root(i), root(ids[k + 1 + j])))
            comp[b] = a
    return {i: root(i) for i in ids}


def test_near_pairs_match_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = base[rng.integers(0, 40, 900)]
    for _ in range(4):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)) * (rng.random(900) < 0.6)
    groups = np.sort(rng.integers(0, 5, 900))
    got = set(zip(*map(list, simhash.near_pairs(fps, groups, 4))))
    want = {(a, b) for a in range(900) for b in range(a + 1, 900) if groups[a] == groups[b] and int(fps[a] ^ fps[b]).bit_count() <= 4}
    assert got == want


@pytest.mark.parametrize("classes", [10, 10**8, 10**11])
def test_some_table_holds_every_pair(classes):
    masks = [m & (2**64 - 1) for m in simhash.block_masks(classes, 4)]
    rng = np.random.default_rng(2)
    for _ in range(300):
        x = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(m & x == 0 for m in masks)


def test_matches_brute_force_on_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 4)
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choice(vocab, int(rng.integers(3, 60))))) for i in range(60)]
    rows += [(100 + i, rows[0][1] + " " + vocab[i % 50]) for i in range(20)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "One"), (204, "ONE"), (205, "a b c"), (206, "É é"), (207, "x " * 5000)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, fp int, component string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(df).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    comp = brute_components(fps)
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in fps}


def test_nulls_repeats_and_empty_tables(spark):
    schema = "doc_id long, text string, source string"
    assert simhash.simhash_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e", "s"), (1, "a b c d e", "s"), (None, "a b c d e", "t"), (None, None, None), (2, "q r s t u v", "s")]
    df = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, simhash.simhash_components(df).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (None, None), (2, 2)], key=str)
    assert simhash.near_dedup(df).columns == ["doc_id", "text", "source"]
    kept = sorted(map(tuple, simhash.near_dedup(df).collect()), key=str)
    assert kept == sorted([(1, "a b c d e", "s"), (2, "q r s t u v", "s"), (None, "a b c d e", "t"), (None, None, None)], key=str)


def test_query_matches_brute_force(spark):
    from folioscan.llm import queries

    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in queries.table(spark, d, "documents").collect()}
    fps = {i: brute_fingerprint(t) for i, t in docs.items()}
    comp = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash_near_dedup(spark, d).collect()}
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in fps}


@pytest.mark.parametrize("n", [2, 63, 64, 65, 130])
def test_groups_of_any_size(n):
    fps = np.arange(n, dtype=np.uint64)
    a, b = simhash.near_pairs(fps, np.zeros(n, int), 4)
    want = sum((i ^ j).bit_count() <= 4 for i in range(n) for j in range(i + 1, n))
    assert len(a) == want and (a < b).all()
