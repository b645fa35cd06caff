from folioscan import derive
from folioscan.functions import search
from folioscan.queries import load, words

D = "/root/testdata/sf0.001"


def test_fuzzy_search_looks_for_a_whole_item(spark, monkeypatch):
    asked = []
    real = search.fuzzy
    monkeypatch.setattr(words.S, "fuzzy", lambda df, wanted, *more: asked.append(wanted) or real(df, wanted, *more))
    load()[0]["f4_fuzzy_search"](spark, D)
    assert asked == [derive.table(spark, D, "benchmark").orderBy("item_id").first()["text"]]
