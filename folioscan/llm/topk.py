"""Exact top-k inner products over norm-sorted vectors.

Vectors become whole numbers, floor(64 x).  A bounded head of the longest vectors gives
every query a first threshold, the k-th best score there.  Candidates are cut in blocks
by descending length and queries by their cut-off, the least length of a vector that can
reach a query's threshold; a block is met by a block of queries only while its longest
vector reaches the least cut-off there, and only by the queries whose own it reaches.  Inside a meeting,
vectors are rotated by the singular vectors of a bounded sample, so that a partial sum
over the first coordinates plus the Cauchy-Schwarz bound on the rest rules most pairs
out; what is left is scored exactly.  The rotation and the head steer the work alone,
never the result.

Work is the stated queries against all rows, in meetings of at most ``QUERIES`` by
``ROWS`` vectors; no task holds more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.vectors import matrix, valid_vectors
from folioscan.storage import materialize

SCALE = 64
QUERIES, ROWS = 2048, 8192
#: Vectors of the head, of the sample for the rotation, and coordinates of the partial sum.
HEAD, SAMPLE, FIRST = 4096, 4096, 16
_STRIPE = 1024


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, v, norm2)`` with ``v`` an array of longs."""
    v = F.transform("v", lambda x: F.floor(F.lit(float(SCALE)) * x))
    out = valid_vectors(rows, id_col, vector_col).select("vec_id", v.alias("v"))
    return out.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def exact_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where that is exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    if most < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


class Best:
    """The k best (score, then smaller id) of each query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None) -> None:
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.vec = np.full((n, k), np.iinfo(np.int64).max)
        self.floor = np.full(n, np.iinfo(np.int64).min) if floor is None else floor.copy()

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Flat triples of query row, candidate id and score."""
        if not len(rows):
            return
        r = np.concatenate([np.repeat(np.arange(len(self.floor)), self.k), rows])
        s = np.concatenate([self.score.ravel(), scores])
        v = np.concatenate([self.vec.ravel(), ids])
        order = np.lexsort((v, ~s, r))
        r, s, v = r[order], s[order], v[order]
        place = np.arange(len(r)) - np.searchsorted(r, r, "left")
        keep = place < self.k
        self.score, self.vec = s[keep].reshape(-1, self.k), v[keep].reshape(-1, self.k)
        self.floor = np.maximum(self.floor, self.score[:, -1])


def search(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, rotation: np.ndarray, best: Best) -> None:
    """Offer to ``best`` every candidate that may be among a query's k best."""
    qn, cn = np.sqrt((q.astype(float) ** 2).sum(1)), np.sqrt((c.astype(float) ** 2).sum(1))
    order = np.argsort(-cn, kind="stable")
    c, c_ids, cn = c[order], c_ids[order], cn[order]
    qr, cr = q @ rotation, c @ rotation
    q_rest = np.sqrt(np.maximum((qr[:, FIRST:] ** 2).sum(1), 0))
    c_rest = np.sqrt(np.maximum((cr[:, FIRST:] ** 2).sum(1), 0))
    for lo in range(0, len(c), _STRIPE):
        hi = lo + _STRIPE
        floor = best.floor.astype(float)
        slack = 1e-9 * (1 + qn * (cn[lo] if len(cn) else 0))
        live = np.flatnonzero(qn * cn[lo] + slack >= floor)
        if not len(live):
            break
        bound = qr[live, :FIRST] @ cr[lo:hi, :FIRST].T + q_rest[live, None] * c_rest[None, lo:hi]
        a, b = np.nonzero((bound + slack[live, None] >= floor[live, None]) & (q_ids[live, None] != c_ids[None, lo:hi]))
        if len(a) * 8 > bound.size:
            scores = exact_products(q[live], c[lo:hi])[a, b]
        else:
            scores = np.concatenate([(q[live[a[i : i + 65536]]] * c[lo + b[i : i + 65536]]).sum(1) for i in range(0, max(len(a), 1), 65536)])
        rows = live[a]
        good = scores >= best.floor[rows]
        best.offer(rows[good], c_ids[lo + b[good]], scores[good])


def top_k(rows: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the rows whose id is divisible by ``every``.

    Null vectors and vectors with null or non-finite components take no part, nor do
    rows without an id; rows that share an id count once, with their least vector, and
    a query is no candidate of its own.  Shorter vectors are filled with zeros.  Ties go
    to the smaller id; with fewer than ``k`` candidates all are returned.
    """
    spark = rows.sparkSession
    base = materialize(whole_vectors(rows, id_col, vector_col), "topk")
    size = base.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"), F.max(F.size("v")).alias("w")).first()
    if not size["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = size["w"]
    head = base.orderBy(F.desc("norm2"), "vec_id").limit(HEAD).toArrow()
    sample = matrix(base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column(0), width)
    rotation = np.linalg.svd(sample.T @ sample)[0]
    h_ids, h = head.column("vec_id").to_numpy(), matrix(head.column("v"), width, np.int64)

    def seeded(batches):
        for b in batches:
            ids, q = b.column(0).to_numpy(), matrix(b.column(1), width, np.int64)
            best = Best(len(ids), k)
            search(ids, q, h_ids, h, rotation, best)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(best.floor)], names=["vec_id", "v", "norm2", "floor"])

    n_query, n_block = -(-size["q"] // QUERIES), -(-size["n"] // ROWS)
    queries = base.where(F.col("vec_id") % every == 0).mapInArrow(seeded, "vec_id long, v array<long>, norm2 double, floor long")
    # a query meets only vectors of at least its cut-off in length: its threshold over its own length
    cutoff = F.when(F.col("floor") > 0, F.col("floor") / F.sqrt(F.greatest("norm2", F.lit(1e-300)))).otherwise(0.0)
    queries = materialize(queries.withColumn("cutoff", cutoff), "topk")
    # blocks of queries of like cut-offs, so that one weak query does not open a block to all
    marks = queries.stat.approxQuantile("cutoff", [i / n_query for i in range(1, n_query)], 0.2 / n_query) if n_query > 1 else []
    place = F.lit(0)
    for mark in sorted(set(marks)):
        place = place + (F.col("cutoff") >= mark).cast("int")
    queries = queries.withColumn("lot", place)
    lots = queries.groupBy("lot").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("lot_parts"))
    queries = queries.join(lots, "lot").withColumn("qb", F.concat_ws(":", "lot", F.pmod(F.xxhash64("vec_id"), F.col("lot_parts").cast("long"))))
    queries = materialize(queries.drop("lot", "lot_parts"), "topk")
    reach = materialize(queries.groupBy("qb").agg(F.min("cutoff").alias("least")), "topk")
    # blocks by descending length, from quantiles: any cut is right, even ones are even work
    cuts = base.stat.approxQuantile("norm2", [i / n_block for i in range(1, n_block)], 0.2 / n_block) if n_block > 1 else []
    block = F.lit(0)
    for cut in sorted(set(cuts)):
        block = block + (F.col("norm2") < cut).cast("int")
    dealt = base.withColumn("cb", block)
    # a length that very many vectors share is cut further, by id
    counts = materialize(dealt.groupBy("cb").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("parts"), F.sqrt(F.max("norm2")).alias("longest")), "topk")
    dealt = dealt.join(counts.select("cb", "parts"), "cb").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts").cast("long")).cast("int"))
    open_ = F.sqrt("norm2") * (1 + 1e-9) >= F.col("least")
    # the blocks are few: one row for each couple that can meet
    couples = materialize(counts.crossJoin(F.broadcast(reach)).where(F.col("longest") * (1 + 1e-9) >= F.col("least")).select("cb", "qb", "parts", "longest", "least"), "topk")
    meets = dealt.join(couples.select("cb", "qb", "least"), "cb").where(open_).select("qb", "cb", "part", "vec_id", "v")
    asks = queries.join(couples.select("cb", "qb", "parts", "longest"), "qb").where(F.col("longest") * (1 + 1e-9) >= F.col("cutoff"))
    asks = asks.select("qb", "cb", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "v", "floor")

    def meet(asked: pa.Table, there: pa.Table) -> pa.Table:
        best = Best(asked.num_rows, k, asked.column("floor").to_numpy())
        ids = asked.column("vec_id").to_numpy()
        if asked.num_rows and there.num_rows:
            search(ids, matrix(asked.column("v"), width, np.int64), there.column("vec_id").to_numpy(), matrix(there.column("v"), width, np.int64), rotation, best)
        got = best.vec != np.iinfo(np.int64).max
        r, c = np.nonzero(got)
        return pa.table({"query_id": ids[r], "vec_id": best.vec[r, c], "score": best.score[r, c]})

    keys = ("qb", "cb", "part")
    found = asks.groupBy(*keys).cogroup(meets.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle_sql(every: int = 20, k: int = 20) -> str:
    """DuckDB SQL over the embeddings table with distinct ids and vectors of one length."""
    return f"""
WITH base AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM base q JOIN base c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {k}
"""
