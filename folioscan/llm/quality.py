"""Quality classification with hierarchical empirical Bayes.

Evidence comes from three levels.  A document classifier (boosted trees over features
of form: symbols, capitals, repetition, line shape) gives each text a probability p.
Hosts and paths get posteriors from grouped sums of p: a host's rate is shrunk towards
the global rate, a path's towards its host's, by strengths that the method of moments
estimates from the spread between sites, so a sparse site says little more than its
parent.  A document's own p is left out of the sums that judge it.  Its score is its own
log-odds moved by the log-odds of its path's posterior less those of the global rate:
Bayes' rule, with the site's rate in place of the global one that p stands on.

A source that is a web address gives its host and first path segment; any other source
is a host by itself, with the language as path.  The classifier is fitted on at most
``SAMPLE`` labelled rows of each class, the first by a hash of the id; posteriors use
every row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.llm.boosting import Trees, fit_trees
from folioscan.storage import materialize, small_batches

#: Labelled rows of each class that the classifier is fitted on, at most.
SAMPLE = 3000
#: Bounds of a shrinkage strength, in documents.
STRENGTH = (10.0, 10_000.0)
_TOKENS_KEPT = 200_000
_WORDLY = re.compile(r"[^\W_]")
_MARKS = re.compile(r"[^\w\s.,;:!?'\"()\-]|[!?]{2,}")
_PLAIN = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum() or chr(b).isspace())


class _Forms(dict):
    """The form of a token, remembered: None for a plain word, else five flags."""

    def __missing__(self, token: str):
        if len(self) >= _TOKENS_KEPT:
            self.clear()
        flags = (not _WORDLY.search(token), bool(_MARKS.search(token)), len(token) > 1 and token.isupper(), any(c.isdigit() for c in token), len(token) > 24)
        got = self[token] = flags if any(flags) else None
        return got


def features(text: str | None, forms: _Forms) -> list[float]:
    text = text or ""
    words, lines = text.split(), text.split("\n")
    n, m = max(len(words), 1), max(len(lines), 1)
    odd = [f for w in words if (f := forms[w])]
    counts = Counter(words)
    raw = text.encode("utf-8", "surrogatepass")
    full = [x for x in lines if x.strip()]
    return [
        *(sum(f[k] for f in odd) / n for k in range(5)),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        len(set(zip(words, words[1:]))) / n,
        len(text) / n,
        len(raw.translate(None, _PLAIN)) / max(len(raw), 1),
        sum(x.rstrip()[-1] in ".!?:;\"')" for x in full) / m,
        len(set(lines)) / m,
        math.log1p(len(words) / m),
        math.log1p(len(words)),
    ]


FEATURES = 14


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE) -> Trees:
    """The document classifier.  Without rows of both classes it gives the smoothed share of the one there is."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.min(label_col).alias("y"))
    # the first of each class by a hash of the id; one pass over the texts fetches both
    pick = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    some = pick[0].unionByName(pick[1])
    got = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").where("text is not null")
    # one row for each id and text, so that copies weigh no more; features alone leave the executors
    got = got.groupBy("doc_id", F.xxhash64("text").alias("k")).agg(F.first("text").alias("text"), F.first("y").cast("int").alias("y"))
    small_batches(docs.sparkSession)
    rows = got.select("doc_id", "k", "text", "y").mapInArrow(_feature_batches, "doc_id long, k long, y int, x array<double>")
    # repeated ids cannot take more than the sample's bound
    kept = rows.orderBy(F.xxhash64("doc_id", "k"), "doc_id", "k").limit(2 * sample).collect()
    kept.sort(key=lambda r: (r["doc_id"], r["k"]))
    x = np.array([r["x"] for r in kept]).reshape(-1, FEATURES)
    y = np.array([r["y"] for r in kept], float)
    trees = fit_trees(x, y)
    # the sample is balanced, the corpus is not: put the labels' own rate back
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(kept) and 0 < y.mean() < 1:
        trees.base += math.log(n[1] / n[0]) - math.log(y.mean() / (1 - y.mean()))
    return trees


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forms = _Forms()
    for batch in batches:
        x = [features(t.as_py(), forms) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "k", "y", "x"])


def _score_batches(trees: Trees, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = _Forms()
        for batch in batches:
            x = np.array([features(t.as_py(), forms) for t in batch.column(at)]).reshape(-1, FEATURES)
            p = 1 / (1 + np.exp(-np.clip(trees.raw(x), -12, 12)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "__p"])

    return run


def score(docs: DataFrame, trees: Trees, text_col: str = "text", source_col: str = "source", path_col: str = "lang") -> DataFrame:
    """``docs`` with ``__p`` (the document classifier), ``__host`` and ``__path``."""
    schema = T.StructType([*docs.schema.fields, T.StructField("__p", T.DoubleType())])
    small_batches(docs.sparkSession)
    out = docs.mapInArrow(_score_batches(trees, docs.columns.index(text_col)), schema)
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    address = F.regexp_extract(source, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]+)", 1)
    part = F.regexp_extract(source, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]+/([^/?#]*)", 1)
    out = out.withColumn("__host", F.when(address != "", F.lower(address)).otherwise(source))
    return out.withColumn("__path", F.when(address != "", part).otherwise(F.coalesce(F.col(path_col).cast("string"), F.lit(""))))


def _strength(groups: DataFrame, parent: Column) -> Column:
    """Prior strength m from the spread of group rates about their parent's: Var = r(1-r)/(m+1) + noise."""
    noise = F.sum(parent * (1 - parent))
    spread = F.sum(F.col("n") * (F.col("s") / F.col("n") - parent) ** 2) - noise
    between = spread / F.greatest(F.sum("n") - F.count("*"), F.lit(1.0))
    mean = noise / F.count("*")
    m = F.when(between > 0, mean / between - 1).otherwise(STRENGTH[1])
    return F.least(F.greatest(F.coalesce(m, F.lit(STRENGTH[1])), F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))


def site_sums(scored: DataFrame) -> DataFrame:
    """``(host, path, n, s, host_n, host_s, m_host, m_path, global_rate)``, one row for each path of each host.

    Counts and sums of p over paths and hosts, and the strengths of shrinkage.
    """
    paths = scored.groupBy(F.col("__host").alias("host"), F.col("__path").alias("path")).agg(F.sum("__p").alias("s"), F.count("*").alias("n"))
    paths = materialize(paths, "quality")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    total = hosts.agg((F.sum("s") + 0.5).alias("s"), (F.sum("n") + 1.0).alias("n")).first()
    rate = total["s"] / total["n"] if total["n"] else 0.5
    m_host = hosts.agg(_strength(hosts, F.lit(rate)).alias("m")).first()["m"]
    rates = hosts.select("host", _shrunk(F.col("s"), F.col("n"), F.lit(rate), m_host).alias("r"))
    joined = paths.join(rates, "host")
    m_path = joined.agg(_strength(joined, F.col("r")).alias("m")).first()["m"]
    named = paths.join(hosts.select("host", F.col("s").alias("host_s"), F.col("n").alias("host_n")), "host")
    return named.select("host", "path", "n", "s", "host_n", "host_s", F.lit(m_host).alias("m_host"), F.lit(m_path).alias("m_path"), F.lit(rate).alias("global_rate"))


def _shrunk(s: Column, n: Column, prior: Column, m: Column | float) -> Column:
    return (s + m * prior) / (n + m)


def site_posteriors(scored: DataFrame) -> DataFrame:
    """``(host, path, n, host_rate, path_rate, global_rate)``, one row for each path of each host."""
    c = F.col
    host = _shrunk(c("host_s"), c("host_n"), c("global_rate"), c("m_host"))
    return site_sums(scored).select("host", "path", "n", host.alias("host_rate"), _shrunk(c("s"), c("n"), host, c("m_path")).alias("path_rate"), "global_rate")


def classify(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``scored`` with ``host, path, doc_score, host_rate, path_rate, score, keep``.

    The rates are those of the other documents of the host and the path.
    """
    c = F.col

    def odds(p: Column) -> Column:
        return F.log(p / (1 - p))

    sums = site_sums(scored).withColumnsRenamed({"host": "__h", "path": "__q", "n": "__n", "s": "__sum", "host_n": "__hn", "host_s": "__hs", "global_rate": "__g", "m_host": "__mh", "m_path": "__mp"})
    out = scored.join(sums, (c("__host") == c("__h")) & (c("__path") == c("__q")))
    host = F.least(F.greatest(_shrunk(c("__hs") - c("__p"), c("__hn") - 1, c("__g"), c("__mh")), F.lit(1e-9)), F.lit(1 - 1e-9))
    out = out.withColumn("host_rate", host)
    path = F.least(F.greatest(_shrunk(c("__sum") - c("__p"), c("__n") - 1, c("host_rate"), c("__mp")), F.lit(1e-9)), F.lit(1 - 1e-9))
    out = out.withColumn("path_rate", path)
    logit = odds(c("__p")) + odds(c("path_rate")) - odds(c("__g"))
    out = out.withColumn("score", 1 / (1 + F.exp(-logit))).withColumn("keep", c("score") >= threshold)
    return out.drop("__h", "__q", "__n", "__sum", "__hn", "__hs", "__g", "__mh", "__mp").withColumnsRenamed({"__p": "doc_score", "__host": "host", "__path": "path"})


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, host, path, doc_score, host_rate, path_rate, score, keep)``, one row per row of ``docs``.

    A null text counts as empty, a null source or language as an empty name; null and
    repeated ids pass through.  Texts are read once.
    """
    scored = materialize(score(docs.select("doc_id", "text", "source", "lang"), fit(docs, labels)).drop("text"), "quality")
    return classify(scored).select("doc_id", "host", "path", "doc_score", "host_rate", "path_rate", "score", "keep")


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns.  Texts are scored once."""
    own = {c: f"__own{i}" for i, c in enumerate(docs.columns)}
    hidden = docs.withColumnsRenamed(own)
    scored = materialize(score(hidden, fit(docs, labels), own["text"], own["source"], own["lang"]), "quality")
    return classify(scored).where("keep").select(*own.values()).withColumnsRenamed({v: k for k, v in own.items()})
