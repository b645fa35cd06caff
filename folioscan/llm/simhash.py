"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: every text gives 4-word shingles (words are runs of characters other
than space and U+0009 to U+000D, ASCII letters lower-cased, repeats kept), each
hashed by XXH64 with seed 42; a bit of the fingerprint is set if it is set in over
half the hashes.  Fewer than four words are one shingle; a text without words, or a
null text, has fingerprint zero, which links like any other.

Linking: equal fingerprints are one class.  By the pigeonhole principle, of
``radius + k`` blocks of bits two linked fingerprints agree in at least ``k``, so
classes meet in the buckets of every choice of ``k`` blocks; ``k`` grows with the
number of classes to keep buckets small.  A bucket of more than ``CHUNK`` classes
is cut in chunks that meet pairwise, so that no task holds an unbounded group and
no pair is lost.  Inside a bucket the bit planes are stored vertically: 64
candidates to a word, one word per bit.  Distances of 64 candidates at a time are
counted by carry-save adders in three bit-sliced counters, and a word of
candidates is abandoned once all of it is beyond the radius.

Buckets return spanning stars, not pairs; `components` joins them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.components import connected_components
from folioscan.storage import materialize, small_batches

SEED, SHINGLE, BITS = 42, 4, 64
CHUNK = 1024
_HASHES_AT_ONCE = 1 << 17
_LANES_AT_ONCE = 1 << 18
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, width: int = SHINGLE) -> list[int]:
    """XXH64 of every shingle of a text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    if len(words) < width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: len(words) - width])]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of ``counts`` hashes."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS)
        starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
        votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        packed = np.packbits(votes * 2 > counts[full, None], axis=1, bitorder="little")
        out[full] = packed.view(np.uint64).ravel()
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, hashes, counts = [], [], []

        def flush() -> None:
            prints.append(majority(np.array(hashes, np.uint64), np.array(counts, np.int64)))
            hashes.clear()
            counts.clear()

        for value in batch.column(1):
            got = shingle_hashes(value.as_py())
            hashes += got
            counts.append(len(got))
            if len(hashes) >= _HASHES_AT_ONCE:
                flush()
        flush()
        fp = pa.array(np.concatenate(prints).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` of every row; ``fp`` holds the 64 bits as a signed long."""
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    return cols.mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def block_masks(classes: int, radius: int) -> list[int]:
    """Masks of the key bits of every bucket table, as signed longs."""
    agree = 1
    while agree < 4 and classes > 4096 << (BITS * agree // (radius + agree)):
        agree += 1
    n = radius + agree
    edges = [BITS * i // n for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(blocks, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_pairs(fps: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs ``a < b`` of the same group within the radius; ``groups`` is sorted."""
    n = len(fps)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[first, n])
    n_words = -(-sizes // 64)
    word_first = np.concatenate([a + 64 * np.arange(w) for a, w in zip(first, n_words)])
    word_end = np.repeat(first + sizes, n_words)
    lanes = np.minimum(64, word_end - word_first)
    # vertical planes: bit b of 64 candidates in one word
    rows = np.minimum(word_first[:, None] + np.arange(64), n - 1)
    bits = np.unpackbits(fps[rows].view(np.uint8).reshape(len(rows), 64, 8), axis=2, bitorder="little")
    planes = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    planes = np.ascontiguousarray(planes).view(np.uint64)[:, :, 0]
    there = np.where(lanes == 64, _ONES, (np.uint64(1) << (lanes % 64).astype(np.uint64)) - np.uint64(1))
    # every candidate against every word of its group
    group_of = np.repeat(np.arange(len(first)), sizes)
    per_row = n_words[group_of]
    upto = np.cumsum(per_row)
    word_base = np.concatenate([[0], np.cumsum(n_words)[:-1]])
    found_a, found_b, lo = [], [], 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _LANES_AT_ONCE, "right")))
        q = np.repeat(np.arange(lo, hi), per_row[lo:hi])
        step = np.arange(len(q)) - np.repeat(np.cumsum(per_row[lo:hi]) - per_row[lo:hi], per_row[lo:hi])
        w = word_base[group_of[q]] + step
        later = word_first[w] + 63 > q  # words wholly before the query were met from the other side
        q, w = q[later], w[later]
        c0, c1, c2, over = (np.zeros(len(q), np.uint64) for _ in range(4))
        for b in range(BITS):
            mine = (fps[q] >> np.uint64(b)) & np.uint64(1)
            carry = planes[b][w] ^ (np.uint64(0) - mine)
            for c in (c0, c1, c2):
                t = c & carry
                c ^= carry
                carry = t
            over |= carry
            over |= _beyond(c0, c1, c2, radius)
            if b % 8 == 7:
                keep = np.flatnonzero(~over & there[w])
                q, w, c0, c1, c2, over = (x[keep] for x in (q, w, c0, c1, c2, over))
        hit = ~over & there[w]
        r, lane = np.nonzero(np.unpackbits(hit.view(np.uint8), bitorder="little").reshape(-1, 64))
        a, c = q[r], word_first[w[r]] + lane
        found_a.append(a[c > a])
        found_b.append(c[c > a])
        lo = hi
    return np.concatenate(found_a), np.concatenate(found_b)


def _beyond(c0: np.ndarray, c1: np.ndarray, c2: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit count is above the radius (of at most 6)."""
    out = np.zeros_like(c0)
    for value in range(radius + 1, 8):
        out |= (c0 if value & 1 else ~c0) & (c1 if value & 2 else ~c1) & (c2 if value & 4 else ~c2)
    return out


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each index's component under the pairs ``(a, b)``."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _star_batches(radius: int):
    def solve(keys: np.ndarray, fps: np.ndarray, reps: np.ndarray) -> pa.RecordBatch:
        a, b = near_pairs(fps.view(np.uint64), keys, radius)
        root = local_roots(len(fps), a, b)
        leaf = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(reps[leaf]), pa.array(reps[root[leaf]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, serial = None, 0
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            new = np.zeros(len(held[0]), bool)
            for key in held[:4]:
                new[1:] |= key[1:] != key[:-1]
            cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
            if cut >= 1 << 14:
                ids = np.cumsum(new)
                yield solve(ids[:cut], held[4][:cut], held[5][:cut])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            new = np.zeros(len(held[0]), bool)
            for key in held[:4]:
                new[1:] |= key[1:] != key[:-1]
            yield solve(np.cumsum(new), held[4], held[5])

    return run


def link_classes(classes: DataFrame, radius: int = 4, chunk: int | None = None) -> DataFrame:
    """Spanning edges ``(u, v)`` of the classes ``(fp, rep)`` within the radius of each other."""
    chunk = chunk or CHUNK
    masks = block_masks(classes.count(), radius)
    tables = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)))
    keyed = classes.select("fp", "rep", F.explode(tables).alias("b")).select("b.t", "b.key", "fp", "rep")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n"))
    hot = materialize(sizes.where(F.col("n") > chunk).select("t", "key", F.ceil(F.col("n") / chunk).cast("int").alias("parts")), "simhash")
    placed = keyed.join(hot, ["t", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # chunk c of p meets every chunk: groups (min, max) of the two
    placed = placed.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("parts").cast("long")).cast("int"))
    placed = placed.select("t", "key", "fp", "rep", "c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("d"))
    placed = placed.select("t", "key", F.least("c", "d").alias("lo"), F.greatest("c", "d").alias("hi"), "fp", "rep")
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(n, "t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi", "rep")
    return dealt.mapInArrow(_star_batches(radius), "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    ``component_id`` is the least document id reachable over links of at most
    ``radius`` differing bits.  Null and empty texts have fingerprint zero and link;
    a null id takes no part as a representative and gets its class's component
    (null if the class has no other id).  Repeated rows stay repeated.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "simhash")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash")
    known = classes.where("rep is not null")
    parts = connected_components(link_classes(known, radius))
    named = materialize(
        classes.join(parts, classes.rep == parts.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id")),
        "simhash",
    )
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def near_dedup(docs: DataFrame, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document of the least id.

    All columns pass through.  Rows that share an id count as one document, of which
    one row stays.  Rows without an id all stay, once for each distinct text.
    """
    parts = simhash_components(docs, radius=radius)
    keep = parts.where("doc_id = component_id").select(F.col("doc_id").alias("__keep")).distinct()
    stay = docs.join(keep, docs.doc_id == F.col("__keep"), "left").where("doc_id is null or __keep is not null")
    stay = stay.withColumn("__keep", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    return stay.dropDuplicates(["doc_id", "__keep"]).drop("__keep")
