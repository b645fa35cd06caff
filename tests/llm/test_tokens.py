import random

import numpy as np
import pyarrow as pa
import pytest

from folioscan.llm import sentencepieces, tokencount
from folioscan.llm.queries import tokenizer

TEXTS = ["It's <|endoftext|> a Été 12 hello's\n\nÇa!!! naïve", "日本語 ΣΑΣ İstanbul \x1c x\x85y ﬁ", "x" * 300, "aaaaaaaaaaaaaa " * 3, "!'re we're 'l", "", "ab" * 4000, "   a   b  ", " ", "\n\n \n x", "<s> <0x0A> 🦜🦜 \t\t", "é combining", "<|startoftext|><|endoftext|>", "1234567", "don't'll've", "\x00\x01"]
TEXTS += ["".join(random.Random(k).choices("abeinrst é!'1\n▁", k=200)) for k in range(60)]


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = [(i, t, 0) for i, t in enumerate([*TEXTS, None, "a b c " * 3000])] + [(None, "a", 0), (0, TEXTS[0], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = tokencount.token_counts(df, path).collect()
    assert len(got) == len(rows)
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert tokencount.token_counts(df.limit(0), path).count() == 0


@pytest.mark.parametrize("text", ["It's a thesre'll naïve 'rex!!'s 12 <|endoftext|> ab", "supercalifragilistic", "x" * 120, "wow!!<|endoftext|><|startoftext|>'re Éa"])
def test_every_prefix_equals_the_library(text):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    lib, p = Tokenizer.from_file(path), tokencount.counter(path).prefixes(text)
    for k in range(len(p.text) + 1):
        n = len(lib.encode(p.text[:k], add_special_tokens=False).ids)
        assert p.at(k) == n
    for budget in range(12):
        assert p.at(p.cut(budget)) <= budget


def test_query_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    from folioscan.llm import queries

    d = "/root/testdata/sf0.001"
    lib = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in queries.table(spark, d, "documents").collect()}
    got = {r.doc_id: r.n_tokens for r in queries.op5_token_counts(spark, d).collect()}
    assert got == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def test_pieces_equal_the_library_and_round_trip(spark):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(i, t) for i, t in enumerate([*TEXTS, None])] + [(None, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sentencepieces.encode_documents(df, path).collect()
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        assert list(by[i].ids) == lib.encode(t or "") and by[i].n_pieces == len(by[i].ids)
        assert by[i].round_trip == (lib.decode(list(by[i].ids)) == (t or ""))
    back = {r.doc_id: r.text for r in sentencepieces.decode_documents(sentencepieces.encode_documents(df, path), path).collect()}
    assert all(back[i] == lib.decode(list(by[i].ids)) for i, _ in rows)
    odd = spark.createDataFrame([(1, None), (2, [None, -5, 99999999]), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in sentencepieces.decode_documents(odd, path).collect()} == {1: None, 2: "", 3: ""}


def test_lattice_equals_merging_by_definition():
    lat = sentencepieces.transducer(tokenizer("piece_bpe_32k.model")).lattice
    rng = random.Random(9)
    for _ in range(300):
        w = tuple(ord(c) for c in rng.choices("abeinrst▁é", k=rng.randint(1, 90)))
        ids, n = lat.paths(np.array(w), np.array([len(w)]))
        assert ids.tolist() == lat.merge(w) and n[0] == len(ids)


def test_random_unicode_counts_equal_the_library():
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    lib, c = Tokenizer.from_file(path), tokencount.counter(path)
    rng = random.Random(21)
    ranges = [(32, 127)] * 3 + [(0, 0x250), (0x2B0, 0x370), (0x370, 0x600), (0x600, 0x1100), (0x1100, 0x1200), (0x1E00, 0x2100), (0x2000, 0x2100), (0xA640, 0xA840), (0xFB00, 0xFFFE), (0x1D400, 0x1D800), (0x1F300, 0x1FB00)]
    texts = ["".join(chr(rng.randrange(*rng.choice(ranges))) if rng.random() < 0.8 else rng.choice(" \n\t'") for _ in range(rng.randint(1, 24))) for _ in range(20000)]
    texts = [t for t in texts if not any(0xD800 <= ord(x) < 0xE000 for x in t)] + [chr(0xA7CB) + "a", chr(0xA7DC) + "b", "⁌ ⃾⃒‒⁼※⃆‎₝"]
    runs = [tokencount._runs(c, t) for t in texts]
    c.learn_runs({r for row in runs for r in row if r is not None})
    for t, row in zip(texts, runs):
        assert sum(1 if r is None else sum(c.runs[r]) for r in row) == len(lib.encode(t, add_special_tokens=False).ids), t


def test_special_strings_take_their_token_of_the_limit(spark):
    path = tokenizer("word_bpe_49k.json")
    rows = [(1, "<|endoftext|>" * 10 + "a b c"), (2, "a b <|endoftext|> c d"), (3, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.fit_words, r.over_limit) for r in tokencount.token_counts(df, path, limit=4).collect()}
    assert got == {1: (13, 0, True), 2: (5, 3, True), 3: (3, 3, False)}


def _counted(path, texts, limit):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return next(tokencount._batches(path, limit)(iter([batch]))).to_pylist()


def _fit_by_definition(c, text, limit):
    left, words = limit, 0
    for k, part in enumerate(c.cut.split(text)):
        cut = [None] if k % 2 else [w for _, w in c.find(c.normalise(part))]
        c.learn(set(cut) - {None})
        for w in cut:
            n = 1 if w is None else c.known[w]
            if n > left:
                return words
            left, words = left - n, words + (w is not None)
    return words


def test_texts_above_the_limit_are_solved_at_once(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    lib, c = Tokenizer.from_file(path), tokencount.WordCounter(path)
    monkeypatch.setitem(tokencount._loaded, path, c)
    monkeypatch.setattr(tokencount, "_WORDS_KEPT", 100)
    solved, solve = [], c.lattice.solve
    monkeypatch.setattr(c.lattice, "solve", lambda *a, **b: solved.append(len(a[1])) or solve(*a, **b))
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abeinrsté", k=7)) + rng.choice(["", ".", "'s"]) for _ in range(80)) for _ in range(30)]
    got = _counted(path, texts, 60)
    assert len(solved) <= 2
    assert [r["n_tokens"] for r in got] == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    assert all(r["over_limit"] for r in got)
    assert [r["fit_words"] for r in got] == [_fit_by_definition(c, t, 60) for t in texts]


def test_runs_counted_together_equal_the_library(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    lib, c = Tokenizer.from_file(path), tokencount.WordCounter(path)
    monkeypatch.setitem(tokencount._loaded, path, c)
    monkeypatch.setattr(tokencount, "_WORDS_KEPT", 500)
    monkeypatch.setattr(tokencount, "_BYTES_AT_ONCE", 1 << 12)
    rng = random.Random(22)
    parts = ["a", "É", "E\u0301", "\u0301", "\u0300\u0323", "'s", "'RE", "\x00", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", "\u180e", "\u200b", "\u1100", "\u1161", "\u11a8", "Σ", "İ", "ſ", "日本", "🦜", "12", "!?", "<|", "<|endoftext|>", "<|startoftext|>", "\ufeff", "the", " ", " ", "\n", "\t", "\x0b", "\x0c", "\r\n"]
    texts = [*TEXTS, *("".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(4000))]
    got = _counted(path, [*texts, None], 12)
    assert [(r["n_bytes"], r["n_tokens"]) for r in got] == [(len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)) for t in [*texts, ""]]
    assert [r["fit_words"] for r in got] == [_fit_by_definition(c, t, 12) for t in [*texts, ""]]
