import random

import pytest

from folioscan.functions import search as S


def _every_window(query, text):
    n = len(query)
    if len(text) <= n:
        return S.similarity(query, text), 0, len(text)
    best = (0.0, 0, n)
    for i in range(len(text) - n + 1):
        score = 100.0 * S._common(S._masks(query), n, text[i : i + n]) / n
        if text[i] in query and score > best[0]:
            best = (score, i, i + n)
    return best


@pytest.mark.parametrize("seed", range(5))
def test_stepping_over_windows_finds_the_same_best(seed):
    r = random.Random(seed)
    for _ in range(200):
        q = "".join(r.choice("abcd ") for _ in range(r.randint(1, 14)))
        t = "".join(r.choice("abcde ") for _ in range(r.randint(0, 60)))
        want = _every_window(q, t)
        assert S.partial_similarity(q, t) == want
        got = S.partial_similarity(q, t, 85.0)
        assert got == want if want[0] >= 85 else got[0] < 85


def test_a_long_text_is_not_compared_at_every_place(monkeypatch):
    calls = []
    real = S._common
    monkeypatch.setattr(S, "_common", lambda *a: calls.append(1) or real(*a))
    r = random.Random(9)
    text = "".join(r.choice("abcdefghijklmnop ") for _ in range(5000))
    S.partial_similarity("the weld was made in place " * 5, text, 85.0)
    assert len(calls) < 500


def test_characters_that_fold_to_one_keep_their_places():
    assert S.fold("Caf\u00e9 \u00bd\t\u00a0x") == ("Cafe 1/2 x", [0, 1, 2, 3, 4, 5, 5, 5, 6, 8, 9])
    assert S.fold("\u00c9t\u00e9\u2014a") == ("Ete-a", [0, 1, 2, 3, 4, 5])


def test_short_lines_that_can_reach_the_cutoff_are_kept(spark):
    q = "reinforced concrete"
    rows = [("d", i, 0, t) for i, t in enumerate([q, q[:15], q[:13], "\ufb03" * 3, "reinforced concr\u00e9te", "x" * 40])]
    got = S.fuzzy(spark.createDataFrame(rows, "doc_key string, page int, group_no int, text string"), q, 85.0).collect()
    assert {r.page for r in got} == {i for i, (*_, t) in enumerate(rows) if _every_window(q, S.fold(t)[0].lower())[0] >= 85}
