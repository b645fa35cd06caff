"""The corpus pipeline: raw documents in, encoded training rows out.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept.
All but the last return the columns that ``docs`` has; columns beyond those of the
documents table pass through under any name.  An empty table passes every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import linededup, mixing, quality, sentencepieces, similar
from folioscan.llm.queries import table, tokenizer
from folioscan.storage import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _sheltered(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` over ``docs`` with all further columns under names that clash with nothing."""
    names = {c: f"__extra{i}" for i, c in enumerate(docs.columns) if c not in COLUMNS}
    hidden = docs.withColumnsRenamed(names)
    return work(hidden).select(*hidden.columns).withColumnsRenamed({v: k for k, v in names.items()})


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return _sheltered(docs, lambda d: quality.filter_quality(d, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go from all texts; ``n_chars`` follows a changed text.

    No document is left whole for its share of such lines; copies are the next stage's.
    """

    def work(d: DataFrame) -> DataFrame:
        cut = linededup.line_dedup(d)
        changed = F.col("n_removed") > 0
        return cut.withColumn("n_chars", F.when(changed, F.length("text").cast(d.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))

    return _sheltered(docs, work)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents of 5-word similarity 0.8 or more one stays."""
    return _sheltered(docs, similar.near_dedup)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to target weights; a document that is taken twice has two rows."""
    return _sheltered(docs, lambda d: mixing.repeated(mixing.mix(d)))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become piece ids, with a check that decoding gives the text back."""
    return sentencepieces.encode_documents(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("mixing", mix),
    ("sentencepiece", sentencepiece),
]

#: Trained trees and shortest paths have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
