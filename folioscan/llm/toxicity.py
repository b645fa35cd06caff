"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon of words and word beginnings is learned from labelled rows by smoothed
log-odds, besides a few fixed words.  Features of a whole text: densities, counts and
the strongest of its lexicon hits, hits near a word of the second person, shares of
tokens in capitals, with symbols or digits inside (obfuscation) or with drawn-out
letters, and rates of exclamation and other punctuation.

The labelled sample is dealt in folds: trees learn from features seen through the
lexicon of the other folds, and calibration from scores of the other folds' trees, so
nothing is judged by what it has taught.  Terms are counted by grouped aggregation and
texts never leave the executors.  Labels come only from rows
whose ``crc32(doc_id) mod 3`` is not 1; ids, sources and languages are no features.
The sample is at most ``SAMPLE`` rows of each label, the first by a hash of the id.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.boosting import Trees, fit_trees, isotonic
from folioscan.storage import materialize, small_batches

#: Labelled rows of each class that a model is fitted on, at most.
SAMPLE = 3000
FOLDS = 3
_TOKENS_KEPT = 200_000
#: Pronouns of the second person.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu toi te ton ta tes vous votre vos tú ti usted ustedes vosotros tus su".split())
#: Insults known without labels, and the log-odds they begin with.
INSULTS, GIVEN = "idiot stupid moron scum loser pathetic disgusting worthless trash clown dumb jerk bastard imbecile filth".split(), 2.5
_SWAP = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": "", "+": ""})
_INSIDE = re.compile(r"\w[*@$!.+_\-]+\w|[^\W\d_]\d+[^\W\d_]|\w[*@$]")
_DRAWN = re.compile(r"(.)\1\1")
_EDGE = ".,;:!?\"'()[]{}<>|#%&$*~`"
_PLAIN = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum() or chr(b).isspace())
FEATURES = 13


def stem(word: str) -> str:
    return word[:5]


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)


def _terms(line: str) -> set[tuple[int, str]]:
    """``(0, word)`` and, for words of over five letters, ``(1, beginning)``."""
    words = {t.strip(_EDGE).lower() for t in line.split()}
    return {(0, w) for w in words} | {(1, stem(w)) for w in words if len(w) > 5}


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_terms(line) for line in batch.column(0).to_pylist()]
        at = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
        flat = [t for f in found for t in f]
        cols = [batch.column(i).take(pa.array(at)) for i in (1, 2, 3)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([k for k, _ in flat], pa.int32()), pa.array([w for _, w in flat], pa.string())], names=["y", "doc", "parts", "kind", "term"])


def learn_lexicons(sample: DataFrame, least: float = 2.0) -> list[Lexicon]:
    """The lexicons of the texts outside fold 0, 1, ..., and of all texts, from ``(doc_id, k, y, fold, text)``.

    A lexicon holds the words and five-letter beginnings whose log-odds of a toxic text,
    less one standard error, reach ``least``.  Counts are grouped on the executors; only
    the terms of the lexicons come to the driver.
    """
    doc = F.struct("doc_id", "k")
    inside = [F.col("fold") != i for i in range(FOLDS)] + [F.lit(True)]
    n = sample.groupBy("y").agg(*(F.count(F.when(c, 1)).alias(f"n{i}") for i, c in enumerate(inside))).collect()
    size = {(r["y"], i): max(r[f"n{i}"], 1) for r in n for i in range(FOLDS + 1)}
    # a line counts once for each label, in its first text, so copies of a text are one witness
    lines = sample.select("y", "fold", doc.alias("doc"), F.explode(F.split("text", "\n")).alias("line"))
    firsts = lines.groupBy("y", "line").agg(*(F.min(F.when(c, F.col("doc"))).alias(f"d{i}") for i, c in enumerate(inside)))
    # one row for each of a line's first texts, with the lexicons that it is first in as bits
    own = [F.col(f"d{i}") for i in range(FOLDS + 1)]
    seen = firsts.select("y", "line", *own, F.explode(F.array_compact(F.array_distinct(F.array(*own)))).alias("doc"))
    parts = sum((F.when(d == F.col("doc"), 1 << i).otherwise(0) for i, d in enumerate(own)), F.lit(0))
    seen = seen.select("line", "y", F.xxhash64("doc").alias("doc"), parts.cast("int").alias("parts"))
    terms = seen.mapInArrow(_term_batches, "y int, doc long, parts int, kind int, term string")
    terms = terms.groupBy("y", "doc", "kind", "term").agg(F.bit_or("parts").alias("parts"))
    per = [F.count(F.when((F.col("y") == v) & (F.col("parts").bitwiseAND(1 << i) != 0), 1)).alias(f"c{v}_{i}") for i in range(FOLDS + 1) for v in (0, 1)]
    counts = terms.groupBy("kind", "term").agg(*per)
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("part"), F.col(f"c0_{i}").alias("c0"), F.col(f"c1_{i}").alias("c1")) for i in range(FOLDS + 1))))
    counts = counts.where("term <> ''").select("kind", "term", each.alias("e")).select("kind", "term", "e.*")
    found = [Lexicon(dict.fromkeys(INSULTS, GIVEN)) for _ in range(FOLDS + 1)]
    odds = {}
    for i in range(FOLDS + 1):
        n0, n1 = size.get((0, i), 1), size.get((1, i), 1)
        odds[i] = F.log((F.col("c1") + 0.5) / (n1 - F.col("c1") + 0.5)) - F.log((F.col("c0") + 0.5) / (n0 - F.col("c0") + 0.5))
    by_part = F.coalesce(*(F.when(F.col("part") == i, o) for i, o in odds.items()))
    low = by_part - F.sqrt(1 / (F.col("c1") + 0.5) + 1 / (F.col("c0") + 0.5))
    strong = counts.where("c1 >= 3").select("part", "kind", "term", low.alias("low")).where(F.col("low") >= least)
    for r in strong.collect():
        (found[r["part"]].stems if r["kind"] else found[r["part"]].words)[r["term"]] = r["low"]
    return found


class _Tokens(dict):
    """What a token means, remembered: None, or (weight, beginning's weight, second person, capitals, obfuscated, drawn out)."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str):
        if len(self) >= _TOKENS_KEPT:
            self.clear()
        bare = token.strip(_EDGE)
        low = bare.lower()
        lex = self.lexicon
        weight = lex.words.get(low, 0.0)
        start = lex.stems.get(stem(low), 0.0)
        hidden = bool(_INSIDE.search(bare))
        if hidden and not weight:
            plain = low.translate(_SWAP)
            weight, start = lex.words.get(plain, 0.0), max(start, lex.stems.get(stem(plain), 0.0))
        caps = len(bare) > 1 and bare.isupper()
        drawn = bool(_DRAWN.search(low))
        if drawn and not weight:
            weight = lex.words.get(re.sub(r"(.)\1+", r"\1", low), 0.0)
        got = (weight, start, low in SECOND, caps, hidden, drawn)
        self[token] = got = got if any(got) else None
        return got


def features(text: str | None, tokens: _Tokens) -> list[float]:
    text = text or ""
    words = text.split()
    n = len(words)
    odd = [(i, m) for i, w in enumerate(words) if (m := tokens[w])]
    hits = [(i, m[0] or m[1], words[i]) for i, m in odd if m[0] or m[1]]
    second = [i for i, m in odd if m[2]]
    near = 0
    if hits and second:
        at = np.array(second)
        where = np.array([i for i, _, _ in hits])
        k = np.searchsorted(at, where)
        gap = np.minimum(np.abs(where - at[np.minimum(k, len(at) - 1)]), np.abs(where - at[np.maximum(k - 1, 0)]))
        near = int((gap <= 4).sum())
    raw = text.encode("utf-8", "surrogatepass")
    per = 100 / max(n, 1)
    return [
        sum(w for _, w, _ in hits) * per,
        max((w for _, w, _ in hits), default=0.0),
        math.log1p(len(hits)),
        float(len({w for _, _, w in hits})),
        sum(1 for _, m in odd if m[1]) * per,
        len(second) * per,
        near * per,
        sum(1 for _, m in odd if m[3]) * per,
        sum(1 for _, m in odd if m[4]) * per,
        sum(1 for _, m in odd if m[5]) * per,
        (text.count("!") + text.count("?")) * per,
        len(raw.translate(None, _PLAIN)) / max(len(raw), 1),
        math.log1p(n),
    ]


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def scores(self, texts: Iterator[str | None], tokens: _Tokens) -> np.ndarray:
        x = np.array([features(t, tokens) for t in texts]).reshape(-1, FEATURES)
        return np.interp(self.trees.raw(x), *self.knots)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _feature_batches(lexicons: list[Lexicon]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = [_Tokens(lexicon) for lexicon in lexicons]
        for batch in batches:
            x = [features(t.as_py(), tokens[f.as_py()]) for t, f in zip(batch.column(4), batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "k", "y", "fold", "x"])

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, sample: int) -> DataFrame:
    """``(doc_id, k, y, fold, text)``: one row for each id and text of at most ``sample`` labelled ids of each class.

    ``k`` is a hash of the text.  Ids with many texts leave no more than ``2 * sample`` rows.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))
    # the first of each class by a hash of the id; one pass over the texts fetches both
    pick = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    some = pick[0].unionByName(pick[1])
    got = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").where("text is not null")
    fold = (F.crc32(F.concat(F.lit("part:"), F.col("doc_id").cast("string"))) % FOLDS).cast("int")
    got = materialize(got.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("k"), "y", fold.alias("fold"), "text"), "toxicity")
    once = got.groupBy("doc_id", "k", "y", "fold").agg(F.first("text").alias("text"))
    if got.count() <= 2 * sample:
        return once
    # repeated ids cannot take more than the sample's bound; keys alone are ordered
    keys = got.select("doc_id", "k").distinct().orderBy(F.xxhash64("doc_id", "k"), "doc_id", "k").limit(2 * sample)
    return once.join(F.broadcast(keys), ["doc_id", "k"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled rows of each class.

    Rows without an id, a text or a 0/1 label teach nothing.  Without rows of both
    classes every text scores the smoothed share of the class there is.  Texts stay on
    the executors: the driver gets lexicons and one row of features for each text.
    """
    small_batches(docs.sparkSession)
    some = labelled_sample(docs, labels, label_col, sample)
    lexicons = learn_lexicons(some)
    # every text is seen through the lexicon of the other folds, and scored by their trees
    seen = some.select("doc_id", "k", "y", "fold", "text").mapInArrow(_feature_batches(lexicons[:FOLDS]), "doc_id long, k long, y int, fold int, x array<double>")
    rows = sorted(seen.collect(), key=lambda r: (r["doc_id"], r["k"]))
    x = np.array([r["x"] for r in rows]).reshape(-1, FEATURES)
    y = np.array([r["y"] for r in rows], float)
    fold = np.array([r["fold"] for r in rows], np.int64)
    raw = np.zeros(len(rows))
    for k in range(FOLDS):
        raw[fold == k] = fit_trees(x[fold != k], y[fold != k]).raw(x[fold == k])
    return Model(lexicons[FOLDS], fit_trees(x, y), isotonic(raw, y))


def _score_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens(model.lexicon)
        for batch in batches:
            scores = model.scores((t.as_py() for t in batch.column(1)), tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs``.

    A null text is scored as an empty one; a row with a null id is not held out.
    """
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    scored = cols.mapInArrow(_score_batches(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
