"""The operator's text form: near-duplicates by 5-word similarity, compared by wide SimHash.

A document is the set of its 5-word shingles (words as in `simhash`: runs of characters
other than space and U+0009 to U+000D, ASCII letters lower-cased).  Fewer than five
words are one shingle, no words are the empty set, which is like itself only.  Two
documents link if the Jaccard similarity of their sets is at least ``SIMILAR``.

Equal sets are one class.  Each class has a SimHash of ``BITS`` bits over its shingles.
At similarity 0.8 about 78 of 512 bits differ, with a deviation of 8; ``RADIUS`` lies
nearly five deviations above that, so distances decide which pairs are worth an exact
test, and hardly ever lose one.  Sets under ``FEW`` shingles are too short for that and
go straight to the test.  Candidates agree in all ``ROWS`` minima of one of ``BANDS``
bands; a pair of similarity 0.8 is missed by all of them with probability 7e-10, more
similar ones with less.  Every link is verified on the texts' own shingles, so none is
below the threshold.

No group is ever written out as pairs.  First one member of each bucket, the hub, is
compared with the others, which joins true groups at linear cost; the hub is the member
with the most company in all its buckets, as the original of a family of copies has.
Buckets that still hold several components are then compared inside tasks, every pair in
the first bucket that both are in: bit planes of 64 candidates to a word, distances
counted by carry-save adders and abandoned beyond the radius; the members that have a
partner left are met once more with their texts, and only spanning edges leave the task.
Big buckets are cut in parts that meet pairwise, so no task holds an unbounded group.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.components import connected_components
from folioscan.storage import materialize, small_batches

WIDTH, SIMILAR = 5, (4, 5)
BANDS, ROWS = 40, 4
WORDS, RADIUS, FEW = 8, 116, 16
BITS = 64 * WORDS
#: Members and shingles of a bucket's part, and members of a bucket that is compared pair by pair.
PART, PART_SHINGLES, SMALL = 512, 1 << 18, 4
_AT_ONCE, _SETS, _LANES = 1 << 12, 64, 1 << 15
_ODD = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(6).integers(0, 1 << 63, 2 * WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: str | None) -> set[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < WIDTH:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(WIDTH)))))


def bands(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``(sets, BANDS)`` keys of sets of hashes that follow each other; no set is empty."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    least = np.minimum.reduceat(hashes[:, None] * _ODD[None, :], starts, axis=0).reshape(-1, BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        key = (key ^ least[:, :, i]) * np.uint64(0xC2B2AE3D27D4EB4F)
        key ^= key >> np.uint64(29)
    return key


def votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes set each of the ``BITS`` bits."""
    out = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), _AT_ONCE):
        high = ((hashes[lo : lo + _AT_ONCE, None] * _MIX[None, :]) >> np.uint64(32)).astype(np.uint32)
        out += np.unpackbits(high.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return out


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes, as ``WORDS`` unsigned longs: bits that over half of them set."""
    return np.packbits(votes(hashes) * 2 > len(hashes), bitorder="little").view(np.uint64)


def _signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        keys, sizes, found, hashes, held, prints = [], [], [], [], [], []

        def flush() -> None:
            if held:
                found.append(bands(np.concatenate(hashes), np.array(held)).ravel())
            hashes.clear()
            held.clear()

        for value in batch.column(2):
            h = np.unique(np.fromiter(map(digest, shingles(value.as_py())), np.uint64))
            raw = h.tobytes()
            keys.append((digest(raw, 1), digest(raw, 2)))
            sizes.append(len(h))
            prints.append(wide_print(h))
            if len(h):
                hashes.append(h)
                held.append(len(h))
                if sum(held) >= _AT_ONCE:
                    flush()
        flush()
        both = np.array(keys, np.uint64).reshape(-1, 2).view(np.int64)
        ends = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) > 0)]) * BANDS
        flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
        fps = np.concatenate(prints).view(np.int64) if prints else np.zeros(0, np.int64)
        wide = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * WORDS, pa.int32()), pa.array(fps))
        cols = [batch.column(0), batch.column(1), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(sizes, pa.int64()), lists, wide]
        yield pa.RecordBatch.from_arrays(cols, names=["id", "th", "ka", "kb", "n", "bands", "fp"])


def alike(a: set, b: set) -> bool:
    over, under = SIMILAR
    both = len(a & b)
    return under * both >= over * (len(a) + len(b) - both)


def _verified_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: OrderedDict[int, set] = OrderedDict()

    def of(key: int, text: pa.Scalar) -> set:
        got = known.get(key)
        if got is None:
            got = known[key] = shingles(text.as_py())
            if len(known) > _SETS:
                known.popitem(last=False)
        else:
            known.move_to_end(key)
        return got

    for batch in batches:
        u, v = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keep = [alike(of(u[i], batch.column(2)[i]), of(v[i], batch.column(3)[i])) for i in range(len(u))]
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs ``(u, v)`` of classes that are similar."""
    u = texts.select(F.col("node").alias("u"), F.col("text").alias("u_text"))
    v = texts.select(F.col("node").alias("v"), F.col("text").alias("v_text"))
    both = pairs.join(u, "u").join(v, "v").select("u", "v", "u_text", "v_text")
    small_batches(pairs.sparkSession)
    return materialize(both.mapInArrow(_verified_batches, "u long, v long"), "similar")


def _open(a: str, b: str) -> Column:
    """Whether two members, by components, sizes and distance, are worth an exact test."""
    over, under = SIMILAR
    near = under * F.least(f"{a}.n", f"{b}.n") >= over * F.greatest(f"{a}.n", f"{b}.n")
    bits = sum((F.bit_count(F.col(f"{a}.fp")[i].bitwiseXOR(F.col(f"{b}.fp")[i])) for i in range(WORDS)), F.lit(0))
    return (F.col(f"{a}.c") != F.col(f"{b}.c")) & near & ((F.least(f"{a}.n", f"{b}.n") < FEW) | (bits <= RADIUS))


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs ``(u, v)`` of rows ``(a, b)`` that are left open."""
    return rows.where(_open("a", "b")).select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def _add7(x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seven bit planes as three planes of their count, by four carry-save adders."""

    def full(a, b, c):
        half = a ^ b
        return half ^ c, (a & b) | (half & c)

    s, c1 = full(x[0], x[1], x[2])
    s, c2 = full(s, x[3], x[4])
    s, c3 = full(s, x[5], x[6])
    return s, *full(c1, c2, c3)


def near_lanes(fps: np.ndarray, q: np.ndarray, lo: int, size: int) -> np.ndarray:
    """For each row of prints ``q`` whether each of ``fps[lo : lo + size]`` is within the radius; ``size <= 64``."""
    rows = np.minimum(lo + np.arange(64), lo + size - 1)
    bits = np.unpackbits(np.ascontiguousarray(fps[rows]).view(np.uint8).reshape(64, -1), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)[:, 0]
    n_counters = RADIUS.bit_length()
    out = np.zeros(len(q), np.uint64)
    live = np.arange(len(q))
    count = np.zeros((n_counters, len(q)), np.uint64)
    over = np.zeros(len(q), np.uint64)
    for w in range(WORDS):
        mine = q[live, w]
        for b in range(0, 64, 7):
            some = [planes[64 * w + k] ^ (np.uint64(0) - ((mine >> np.uint64(k)) & np.uint64(1))) for k in range(b, min(b + 7, 64))]
            some += [np.zeros(len(live), np.uint64)] * (7 - len(some))
            carry = np.zeros(len(live), np.uint64)
            for level, add in enumerate(_add7(some)):
                half = count[level] ^ add
                carry, count[level] = (count[level] & add) | (half & carry), half ^ carry
            for level in range(3, n_counters):
                carry, count[level] = count[level] & carry, count[level] ^ carry
            over |= carry
        # lanes whose count is above the radius, compared bit by bit from the highest
        above, equal = over.copy(), ~over
        for level in range(n_counters - 1, -1, -1):
            if not RADIUS >> level & 1:
                above |= equal & count[level]
                equal &= ~count[level]
            else:
                equal &= count[level]
        over = above
        keep = np.flatnonzero(over != _ONES)
        live, count, over = live[keep], np.ascontiguousarray(count[:, keep]), over[keep]
        if not len(live):
            break
    out[live] = ~over
    there = _ONES if size == 64 else (np.uint64(1) << np.uint64(size)) - np.uint64(1)
    hit = np.unpackbits((out & there).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return hit[:, :size].astype(bool)


def candidate_pairs(fps: np.ndarray, n: np.ndarray, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs ``a < b``, by blocks of 64, that components, sizes and distance leave open."""
    over, under = SIMILAR
    for lo in range(0, len(n), 64):
        size = min(64, len(n) - lo)
        upto = lo + size
        if len(n) <= 128:  # too few to fill the lanes
            near = np.bitwise_count(fps[:upto, None] ^ fps[None, lo:upto]).sum(2, dtype=np.int64) <= RADIUS
        else:
            near = near_lanes(fps, fps[:upto], lo, size)
        there, all_ = np.arange(lo, upto), np.arange(upto)
        near |= np.minimum(n[all_, None], n[None, there]) < FEW
        near &= (c[all_, None] != c[None, there]) & (all_[:, None] < there[None, :])
        near &= under * np.minimum(n[all_, None], n[None, there]) >= over * np.maximum(n[all_, None], n[None, there])
        a, b = np.nonzero(near)
        yield a, lo + b


def _own_pairs(keys: tuple, part: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The open pairs that this meeting of two parts of a bucket has to compare.

    A pair belongs to the first bucket that both are in, and there to the meeting of its parts.
    """
    h, lo, hi = (k.as_py() for k in keys)
    fps = part.column("fp").combine_chunks().flatten().to_numpy().reshape(-1, WORDS).view(np.uint64)
    tables = part.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    n, c, piece = (part.column(x).to_numpy() for x in ("n", "c", "piece"))
    at = int(np.flatnonzero(tables[0] == h)[0]) if len(tables) else 0
    for a, b in candidate_pairs(fps, n, c):
        met = (np.minimum(piece[a], piece[b]) == lo) & (np.maximum(piece[a], piece[b]) == hi)
        a, b = a[met], b[met]
        first = ~(tables[a, :at] == tables[b, :at]).any(1)
        yield a[first], b[first]


def _partnered(keys: tuple, part: pa.Table) -> pa.Table:
    """The members of a meeting that have an open pair in it."""
    has = np.zeros(part.num_rows, bool)
    for a, b in _own_pairs(keys, part):
        has[a] = has[b] = True
    return part.filter(pa.array(has)).select(["h", "lo", "hi", "piece", "node", "n", "c", "fp", "bands"])


def _spanned(keys: tuple, part: pa.Table) -> pa.Table:
    """Spanning edges of the links of a meeting; pairs that are joined already are not tested."""
    text, node, c = part.column("text"), part.column("node").to_numpy(), part.column("c").to_numpy()
    sets: list[set | None] = [None] * len(node)
    at = {x: i for i, x in enumerate(dict.fromkeys(c.tolist()))}
    group = [at[x] for x in c.tolist()]
    parent = list(range(len(at)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    u, v = [], []
    for a, b in _own_pairs(keys, part):
        for i, j in zip(a.tolist(), b.tolist()):
            p, q = root(group[i]), root(group[j])
            if p == q:
                continue
            for k in (i, j):
                if sets[k] is None:
                    sets[k] = shingles(text[k].as_py())
            if alike(sets[i], sets[j]):
                parent[p] = q
                u.append(int(node[i]))
                v.append(int(node[j]))
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


_MEETING = "h long, lo int, hi int, piece int, node long, n long, c long, fp array<long>, bands array<long>"


def _met_in_tasks(mine: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``(u, v)`` between the members ``(h, m, bands, parts)`` of buckets, compared inside tasks."""
    cut = F.pmod(F.xxhash64("m.node"), F.col("parts").cast("long")).cast("int")
    rows = mine.withColumn("piece", cut).select("h", "m", "bands", "piece", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("d"))
    rows = rows.select("h", F.least("piece", "d").alias("lo"), F.greatest("piece", "d").alias("hi"), "piece", "m.node", "m.n", "m.c", "m.fp", "bands")
    some = materialize(rows.groupBy("h", "lo", "hi").applyInArrow(_partnered, _MEETING), "similar")
    full = some.join(texts.select("node", "text"), "node")
    return materialize(full.groupBy("h", "lo", "hi").applyInArrow(_spanned, "u long, v long"), "similar")


def _components(docs: DataFrame) -> DataFrame:
    """``(id, th, component)`` of one document of each class of equal sets; the component is a class number."""
    slim = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    small_batches(docs.sparkSession)
    signed = slim.mapInArrow(_signature_batches, "id long, th long, ka long, kb long, n long, bands array<long>, fp array<long>")
    classes = signed.groupBy("ka", "kb").agg(F.min(F.struct("id", "th")).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("fp").alias("fp"))
    # the number of a class is written with it, once
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "rep.id", "rep.th", "n", "bands", "fp"), "similar")
    each = classes.select("node", F.explode("bands").alias("h"))
    shared = materialize(each.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "similar")
    company = each.join(shared, "h").groupBy("node").agg(F.sum("m").alias("company"), F.collect_list("h").alias("in"))
    members = company.join(classes.select("node", "n", "fp"), "node").select("node", "n", "fp", "company", F.explode("in").alias("h"))
    members = materialize(members, "similar")
    # a class takes part in many buckets, its text is fetched once
    asked = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "id", "th")
    texts = slim.join(asked, ["id", "th"]).groupBy("node").agg(F.first("text").alias("text"))
    texts = materialize(texts, "similar")
    placed = members.select("h", F.struct("node", "n", "fp", F.col("node").alias("c")).alias("m"), "company")
    hub = F.min(F.struct((-F.col("company")).alias("r"), F.col("m.node").alias("node"), "m")).alias("d")
    hubs = placed.groupBy("h").agg(hub).select("h", F.col("d.m").alias("b"))
    edges = _verified(_pairs(placed.join(hubs, "h").withColumnRenamed("m", "a")), texts)
    parts = connected_components(edges).select(F.col("node").alias("__n"), "component")
    placed = members.join(parts, F.col("node") == F.col("__n"), "left")
    placed = placed.select("h", F.struct("node", "n", "fp", F.coalesce("component", "node").alias("c")).alias("m"))
    about = placed.groupBy("h").agg(F.min("m.c").alias("lo"), F.max("m.c").alias("hi"), F.count("*").alias("size"), F.sum("m.n").alias("words"))
    cut = F.greatest(F.ceil(F.col("size") / PART), F.ceil(F.col("words") / PART_SHINGLES))
    about = about.where("lo < hi").select("h", "size", F.least(cut, F.col("size")).cast("int").alias("parts"))
    mine = materialize(placed.join(about, "h").select("h", "m", "size", "parts"), "similar")
    few = mine.where(F.col("size") <= SMALL)
    pairs = few.select("h", F.col("m").alias("a")).join(few.select("h", F.col("m").alias("b")), "h").where("a.c < b.c")
    many = mine.where(F.col("size") > SMALL).join(classes.select(F.col("node").alias("__n"), "bands"), F.col("m.node") == F.col("__n")).drop("__n")
    edges = edges.unionByName(_verified(_pairs(pairs), texts)).unionByName(_met_in_tasks(many, texts))
    parts = connected_components(edges)
    named = classes.select("node", "id", "th").join(parts.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left")
    return materialize(named.select("id", "th", F.coalesce("component", "node").alias("component")), "similar")


def similar_components(docs: DataFrame) -> DataFrame:
    """``(doc_id, component_id)`` of one document, of the least id, of each class of equal sets.

    ``component_id`` is the least document id reachable over links.  Rows without an id
    take no part.  Different texts under one id are different documents.
    """
    found = _components(docs)
    least = found.groupBy("component").agg(F.min("id").alias("component_id"))
    return found.join(least, "component").select(F.col("id").alias("doc_id"), "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document of the least id.

    All columns pass through.  Rows equal in id and text count as one document, of which
    one row stays; different texts under one id are different documents.  Rows without
    an id all stay, once for each distinct text.
    """
    keep = _components(docs).groupBy("component").agg(F.min(F.struct("id", "th")).alias("k"))
    keep = keep.select(F.col("k.id").alias("__id"), F.col("k.th").alias("__keep"))
    rows = docs.withColumn("__th", F.xxhash64("text"))
    stay = rows.join(keep, (F.col("doc_id") == F.col("__id")) & (F.col("__th") == F.col("__keep")), "left")
    return stay.where("doc_id is null or __keep is not null").dropDuplicates(["doc_id", "__th"]).drop("__id", "__keep", "__th")
