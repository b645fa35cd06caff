import re
from itertools import combinations

import numpy as np

import corpus_pipeline as cp
from folioscan.llm import similar
from folioscan.llm.queries import table


def brute_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def brute_components(docs):
    sets = {i: brute_set(t) for i, t in docs.items()}
    comp = {i: i for i in docs}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, b in combinations(sorted(docs), 2):
        x, y = sets[a], sets[b]
        if x == y or 5 * len(x & y) >= 4 * len(x | y):
            p, q = sorted((root(a), root(b)))
            comp[q] = p
    return {i: root(i) for i in docs}


def test_stage_links_five_word_similarity(spark):
    rng = np.random.default_rng(6)
    vocab = [f"w{i}" for i in range(400)]
    docs, at = {}, 0
    for _ in range(25):
        base = list(rng.choice(vocab, int(rng.integers(60, 160))))
        for _ in range(6):
            words = list(base)
            for k in rng.integers(0, len(words), int(rng.integers(0, 6))):
                words[k] = str(rng.choice(vocab))
            docs[at] = " ".join(words)
            at += 1
    docs |= {500: None, 501: "", 502: " \t\n", 503: "One", 504: "ONE", 505: "a b c", 506: "a b c d"}
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long")
    want = brute_components(docs)
    got = {r.doc_id: r.component_id for r in similar.similar_components(df).collect()}
    assert all(want[i] == c for i, c in got.items())
    stay = {r.doc_id for r in cp.near_dedup(spark, df, "").collect()}
    assert stay == set(want.values())
    assert len(stay) < 150


def test_stage_matches_brute_force_on_the_driver_table(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in table(spark, d, "documents").collect()}
    stay = {r.doc_id for r in cp.near_dedup(spark, table(spark, d, "documents"), d).collect()}
    assert stay == set(brute_components(docs).values())


def test_nulls_repeats_and_empty_tables(spark):
    schema = "doc_id long, text string, source string"
    assert similar.near_dedup(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e", "s"), (1, "a b c d e", "s"), (None, "a b c d e", "t"), (None, None, None), (2, "q r s t u v", "s")]
    kept = sorted(map(tuple, similar.near_dedup(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert kept == sorted([(1, "a b c d e", "s"), (2, "q r s t u v", "s"), (None, "a b c d e", "t"), (None, None, None)], key=str)


def test_repeated_ids_with_other_texts_are_kept(spark):
    rows = [(1, "a b c d e f g", "s"), (1, "q r s t u v w", "s"), (1, "a b c d e f g", "s"), (2, "q r s t u v w", "s")]
    kept = sorted(map(tuple, similar.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()))
    assert kept == [(1, "a b c d e f g", "s"), (1, "q r s t u v w", "s")]


def test_lanes_count_distances_exactly():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (1, similar.WORDS), dtype=np.uint64)
    flips = rng.random((150, similar.BITS)) < rng.uniform(0, 0.3, (150, 1))
    fps = base ^ np.packbits(flips, axis=1, bitorder="little").view(np.uint64)
    far = np.bitwise_count(fps[:, None, :] ^ fps[None, :, :]).sum(2)
    for lo, size in ((0, 64), (64, 64), (128, 22)):
        assert (similar.near_lanes(fps, fps, lo, size) == (far[:, lo : lo + size] <= similar.RADIUS)).all()


def test_big_buckets_are_cut_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(similar, "PART", 8)
    monkeypatch.setattr(similar, "SMALL", 2)
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(80)]
    docs = {}
    for i in range(60):
        words = list(base)
        for k in rng.integers(0, 80, int(rng.integers(0, 7))):
            words[k] = f"x{rng.integers(0, 1000)}"
        docs[i] = " ".join(words)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = brute_components(docs)
    assert {r.doc_id: r.component_id for r in similar.similar_components(df).collect()}.items() <= want.items()
    assert {r.doc_id for r in similar.near_dedup(df).collect()} == set(want.values())


def test_distances_hardly_lose_a_similar_pair():
    rng = np.random.default_rng(8)
    lost = 0
    for n in (20, 60, 400):
        for _ in range(400):
            both = rng.integers(0, 2**63, int(n * 0.8) + 1, dtype=np.uint64)
            a, b = (np.concatenate([both, rng.integers(0, 2**63, (n - len(both)) // 2, dtype=np.uint64)]) for _ in range(2))
            lost += int(np.bitwise_count(similar.wide_print(a) ^ similar.wide_print(b)).sum()) > similar.RADIUS
    assert lost == 0
