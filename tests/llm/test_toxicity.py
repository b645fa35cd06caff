import numpy as np

from folioscan.llm import boosting, toxicity
from folioscan.llm.queries import table


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = toxicity.fit(docs, labels)
    got = toxicity.toxicity(docs, model).join(labels, "doc_id").where("held_out").collect()
    tox = [r for r in got if r.toxic == 1]
    assert np.mean([r.predicted for r in tox]) > 0.9
    assert np.mean([r.predicted for r in got if r.toxic == 0]) < 0.02
    assert all(0 <= r.score <= 1 for r in got)


def test_no_labels_and_awkward_rows(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "You idiot! " * 50000)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(docs.limit(0), toxicity.fit(docs, labels)).count() == 0


def test_labels_of_held_out_rows_teach_nothing(spark):
    import zlib

    docs = spark.createDataFrame([(i, f"plain words number {i} " + ("zorgle blip" if i % 2 else "")) for i in range(300)], "doc_id long, text string")
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in held], "doc_id long, quality int, toxic int")
    assert "zorgle" not in toxicity.fit(docs, labels).lexicon.words


def test_obfuscated_words_are_met():
    lex = toxicity.Lexicon({"idiot": 3.0})
    t = toxicity._Tokens(lex)
    assert t["1d1ot"][0] == 3.0 and t["i.d.i.o.t"][0] == 3.0 and t["IDIOT!!"][3] and t["plain"] is None


def test_isotonic_is_monotone_and_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    trees = boosting.fit_trees(x[:600], y[:600])
    assert (((trees.raw(x[600:]) > 0) == y[600:]).mean()) > 0.9
    xs, ps = boosting.isotonic(trees.raw(x[600:]), y[600:])
    assert (np.diff(ps) >= 0).all() and (np.diff(xs) >= 0).all() and 0 < ps[0] and ps[-1] < 1


def plain_lexicon(texts, labels):
    """Term weights as the docstrings define them, counted in one loop over texts in the order of their ids."""
    import math
    from collections import Counter

    counts = [[Counter(), Counter()], [Counter(), Counter()]]
    seen = [set(), set()]
    for text, y in zip(texts, labels):
        new = set(text.split("\n")) - seen[y]
        seen[y] |= new
        words = {t.strip(toxicity._EDGE).lower() for line in new for t in line.split()}
        counts[0][y].update(words)
        counts[1][y].update({w[:5] for w in words if len(w) > 5})
    n = [max(labels.count(y), 1) for y in (0, 1)]
    out = [dict.fromkeys(toxicity.INSULTS, toxicity.GIVEN), {}]
    for kind in (0, 1):
        for w, c in counts[kind][1].items():
            d = counts[kind][0][w]
            low = math.log((c + 0.5) / (n[1] - c + 0.5)) - math.log((d + 0.5) / (n[0] - d + 0.5)) - math.sqrt(1 / (c + 0.5) + 1 / (d + 0.5))
            if w and c >= 3 and low >= 2:
                out[kind][w] = low
    return out


def test_lexicons_match_a_plain_count(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    sample = toxicity.labelled_sample(docs, labels, "toxic", toxicity.SAMPLE)
    rows = sorted(sample.collect(), key=lambda r: (r.doc_id, r.k))
    assert len(rows) > 100 and not any(__import__("zlib").crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    for part, got in enumerate(toxicity.learn_lexicons(sample)):
        mine = [r for r in rows if r.fold != part]
        words, stems = plain_lexicon([r.text for r in mine], [r.y for r in mine])
        assert got.words.keys() == words.keys() and got.stems.keys() == stems.keys() and len(words) > len(toxicity.INSULTS)
        assert np.allclose([got.words[w] for w in words], list(words.values())) and np.allclose([got.stems[w] for w in stems], list(stems.values()))


def test_an_id_with_many_texts_keeps_the_bound(spark):
    docs = spark.createDataFrame([(0, f"text {i % 50}") for i in range(400)] + [(i, "other") for i in (2, 3, 4, 5)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int")
    rows = toxicity.labelled_sample(docs, labels, "toxic", 10).collect()
    assert len(rows) == 20 and len({(r.doc_id, r.k) for r in rows}) == 20
