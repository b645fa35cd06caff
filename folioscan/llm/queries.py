"""The registered queries of this subpackage, ``{name: (spark, sf_dir) -> DataFrame}``, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import embeddup, linededup, mixing, pii, quality, sentencepieces, simhash, tokencount, topk, toxicity
from folioscan.storage import materialize, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file, in each process that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_documents(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # only words are mixed here, so the texts are read once and left behind
    slim = docs.select("doc_id", "source", F.xxhash64("text").alias("text"), mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(materialize(slim, "mix"), size_col="size")
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddup.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_simhash_near_dedup, op3_line_dedup, op4_sentencepiece, op5_token_counts, op6_exact_top_k, op7_mixing, op8_toxicity, op9_pii, op10_embedding_near_dedup)}

#: DuckDB SQL by query.  Queries without an entry are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {"op3_line_dedup": linededup.oracle_sql(), "op6_exact_top_k": topk.oracle_sql(), "op7_mixing": mixing.oracle_sql()}
