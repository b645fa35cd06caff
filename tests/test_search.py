import random

import pytest

from folioscan.functions import search as S


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diag = 0
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], diag + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_similarity_equals_its_definition():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("abcd ", k=rng.randint(1, 20))) for _ in range(2))
        assert S.similarity(a, b) == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)))


def test_the_pair_bound_never_loses_a_hit():
    rng = random.Random(2)
    for _ in range(4000):
        q = "".join(rng.choices("abcdefgh", k=rng.randint(6, 24)))
        t = list(q)
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randint(0, 1)] = rng.choices("abcdefgh", k=rng.randint(0, 1))
        text = "zz" * rng.randint(0, 3) + "".join(t) + "y" * rng.randint(0, 5)
        for cutoff in (70.0, 85.0, 95.0):
            if S.partial_similarity(q, text)[0] >= cutoff:
                assert sum(p in text for p in {q[i : i + 2] for i in range(len(q) - 1)}) >= S.pairs_needed(q, cutoff)


def test_folding_keeps_offsets():
    text = "Créer  l’œuvre — ½ ﬁn"
    folded, at = S.fold(text)
    assert folded.startswith("Creer l'") and len(at) == len(folded) + 1
    assert S.find_spans(text, "creer l'", False, False) == [(0, 9)]
    assert S.find_spans(text, "fin", False, False) == [(len(text) - 2, len(text))]


def test_hyphenated_line_ends():
    text = "the re- inforced wall"
    assert S.find_spans(text, "reinforced", False, False, [7]) == [(4, 16)]
    assert S.find_spans(text, "re-inforced", False, False, [7]) == [(4, 16)]
    assert S.find_spans(text, "reinforced", False, False) == []


def test_search_frame_and_errors(spark):
    df = spark.createDataFrame([("d", 0, 0, "Wall A and wall B"), ("d", 1, 0, None), ("d", 2, 0, "no")], "doc_key string, page int, group_no int, text string")
    hits = S.search(df, "wall").orderBy("page", "start").collect()
    assert [(h.page, h.start, h.end, h.matched) for h in hits] == [(0, 0, 4, "Wall"), (0, 11, 15, "wall")]
    assert S.search(df, "wall", case=True).count() == 1
    with pytest.raises(ValueError):
        S.search(df, "(", regex=True)
    assert S.fuzzy(df, "wal1 a and", 75).count() == 1
    cut = S.first_hits(S.search(df, "wall"), ["page", "start"], 1).collect()
    assert len(cut) == 1 and cut[0].truncated
    assert S.snippet("x" * 200, 100, 103).startswith("…") and S.snippet("abc", 0, 1) == "abc"
