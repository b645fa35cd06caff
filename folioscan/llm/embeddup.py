"""Embedding near-duplicates over a robust-pruned flat graph.

Vectors equal component by component are one class.  Classes go to the shards of their
``OVERLAP`` nearest centres (k-means on a bounded sample), so neighbours across a border
meet in some shard.  In each shard every class gets neighbours by robust pruning: the
nearest candidate stays and removes the candidates that it is much nearer to than the
class itself.  Adjacency lists are joined over shards.  A search then descends greedily
from the shard's medoid to each class and expands: every class in range opens its
neighbours until no new one is in range.  Pairs are verified by cosine in double
precision before they link.

Classes drawn without regard to what was found are audited against all rows; while
their mean recall stays under ``RECALL`` the shards are made to overlap more and the graph is built again.

Shards of more than ``PART`` classes are cut in parts that meet pairwise.  Shards return
link counts and spanning stars, not pairs; a pair counts in the least shard both are in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.components import connected_components
from folioscan.llm.simhash import local_roots
from folioscan.llm.vectors import matrix
from folioscan.storage import materialize, small_batches

THRESHOLD = 0.9
OVERLAP, PART, SHARD_ROWS = 3, 2048, 1500
#: Classes that centres are fitted on, centres at most, classes drawn at once for the audit.
SAMPLE, CENTRES, AUDIT = 16384, 2048, 2048
#: Classes with true links that an audit asks for, and classes it draws at most.
LINKED, MOST = 200, 1 << 18
RECALL = 0.98
DEGREE, CANDIDATES, ALPHA = 24, 64, 1.2
#: A search opens neighbours this far below the threshold, so thin spots don't end it.
SLACK = 0.08
_BEAM, _AT_ONCE = 8, 512
#: Nodes opened at once, and pairs whose vectors are gathered at once.
_OPENED, _PAIRS = 4096, 16384


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres_of(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(rounds):
        near = (sample @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def dots(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The products of rows ``a`` and ``b``, pair by pair."""
    out = np.zeros(len(a))
    for lo in range(0, len(a), _PAIRS):
        out[lo : lo + _PAIRS] = np.einsum("ij,ij->i", x[a[lo : lo + _PAIRS]], x[b[lo : lo + _PAIRS]])
    return out


def least_common(shards: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least shard that rows ``a`` and ``b`` share, pair by pair."""
    out = np.full(len(a), np.iinfo(np.int64).max)
    for lo in range(0, len(a), _PAIRS):
        mine, other = shards[a[lo : lo + _PAIRS]], shards[b[lo : lo + _PAIRS]]
        common = (mine[:, :, None] == other[:, None, :]).any(2)
        out[lo : lo + _PAIRS] = np.where(common, mine, np.iinfo(np.int64).max).min(1)
    return out


def nearest_centres(x: np.ndarray, centres: np.ndarray, overlap: int) -> np.ndarray:
    """The numbers of the ``overlap`` nearest centres of every row, ascending.

    Rows are taken ``_AT_ONCE`` at a time: a whole batch against all centres is what an
    executor's memory would have to hold three times over.
    """
    m = min(overlap, len(centres))
    out = np.zeros((len(x), m), np.int32)
    for lo in range(0, len(x), _AT_ONCE):
        near = np.argpartition(-(x[lo : lo + _AT_ONCE] @ centres.T), m - 1, axis=1)[:, :m]
        out[lo : lo + _AT_ONCE] = np.sort(near, axis=1)
    return out


def prune(x: np.ndarray) -> np.ndarray:
    """Neighbours of every row by robust pruning of its nearest ``CANDIDATES``; -1 fills."""
    n = len(x)
    out = np.full((n, DEGREE), -1, np.int64)
    c = min(CANDIDATES, n - 1)
    if c < 1:
        return out
    for lo in range(0, n, _AT_ONCE):
        rows = np.arange(lo, min(lo + _AT_ONCE, n))
        sim = x[rows] @ x.T
        sim[np.arange(len(rows)), rows] = -2
        near = np.argpartition(-sim, c - 1, axis=1)[:, :c]
        s = np.take_along_axis(sim, near, 1)
        order = np.argsort(-s, axis=1, kind="stable")
        near, s = np.take_along_axis(near, order, 1), np.take_along_axis(s, order, 1)
        far = np.sqrt(np.maximum(2 - 2 * s, 0))
        near_x = x[near]
        among = np.sqrt(np.maximum(2 - 2 * (near_x @ near_x.transpose(0, 2, 1)), 0))
        open_ = np.ones(near.shape, bool)
        for d in range(DEGREE):
            has = open_.any(1)
            if not has.any():
                break
            pick = open_.argmax(1)
            r = np.flatnonzero(has)
            out[lo + r, d] = near[r, pick[r]]
            open_[r] &= ALPHA * among[r, pick[r]] > far[r]
            open_[r, pick[r]] = False
    return out


def range_search(x: np.ndarray, start: np.ndarray, links: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``a < b`` that range-expanding greedy search finds over the flat graph.

    ``links[start[i]:start[i + 1]]`` are the neighbours of row ``i``.
    """
    n = len(x)
    medoid = int((x @ x.mean(0)).argmax()) if n else 0
    found = []
    degree = np.diff(start)

    def opened(q: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = degree[node]
        upto = np.cumsum(size)
        at = np.repeat(start[node] - (upto - size), size) + np.arange(int(upto[-1]) if len(upto) else 0)
        return np.repeat(q, size), links[at]

    for lo in range(0, n, _AT_ONCE):
        m = min(_AT_ONCE, n - lo)
        mine = np.arange(m)
        seen = np.zeros((m, n), bool)
        pool = np.full((m, _BEAM), -1, np.int64)
        sim = np.full((m, _BEAM), -3.0)
        done = np.ones((m, _BEAM), bool)
        pool[:, 0], done[:, 0] = medoid, False
        sim[:, 0] = x[lo : lo + m] @ x[medoid]
        seen[mine, medoid] = True
        all_q, all_v, all_s = [mine], [pool[:, 0].copy()], [sim[:, 0].copy()]
        while True:
            best = np.where(done, -3.0, sim).argmax(1)
            live = np.flatnonzero(~done[mine, best])
            # a query that has met its own vector is at its goal
            live = live[~seen[live, lo + live]]
            if not len(live):
                break
            done[live, best[live]] = True
            q, v = opened(live, pool[live, best[live]])
            q, v = _fresh(q, v, seen)
            s = dots(x, lo + q, v)
            all_q.append(q), all_v.append(v), all_s.append(s)
            pool, sim, done = _merge(q, v, s, pool, sim, done)
        # every query knows its own row; expand from all it has met in range
        lost = np.flatnonzero(~seen[mine, lo + mine])
        seen[lost, lo + lost] = True
        q, v, s = (np.concatenate(z) for z in (all_q + [lost], all_v + [lo + lost], all_s + [np.ones(len(lost))]))
        while len(q):
            near = s >= threshold - SLACK
            hit = s >= threshold - 1e-6
            found.append((lo + q[hit], v[hit]))
            q, v = q[near], v[near]
            new = [_fresh(*opened(q[at : at + _OPENED], v[at : at + _OPENED]), seen) for at in range(0, len(q), _OPENED)]
            q, v = (np.concatenate([z[k] for z in new] or [np.zeros(0, np.int64)]) for k in (0, 1))
            s = dots(x, lo + q, v)
    a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    b = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    key = np.unique(np.minimum(a, b)[a != b] * n + np.maximum(a, b)[a != b])
    return key // max(n, 1), key % max(n, 1)


def _fresh(q: np.ndarray, v: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = ~seen[q, v]
    key = np.unique(q[new] * seen.shape[1] + v[new])
    q, v = key // seen.shape[1], key % seen.shape[1]
    seen[q, v] = True
    return q, v


def _merge(q, v, s, pool, sim, done):
    """The best of pool and newcomers for each query."""
    m = len(pool)
    r = np.concatenate([np.repeat(np.arange(m), _BEAM), q])
    vv, ss, dd = np.concatenate([pool.ravel(), v]), np.concatenate([sim.ravel(), s]), np.concatenate([done.ravel(), np.zeros(len(q), bool)])
    order = np.lexsort((-ss, r))
    r, vv, ss, dd = r[order], vv[order], ss[order], dd[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r, "left") < _BEAM
    return vv[keep].reshape(m, -1), ss[keep].reshape(m, -1), dd[keep].reshape(m, -1)


def _graph(keys: tuple, part: pa.Table) -> pa.Table:
    x = unit(matrix(part.column("v")))
    ids = part.column("rep").to_numpy()
    near = prune(x)
    r, c = np.nonzero(near >= 0)
    a, b = ids[r], ids[near[r, c]]
    # a flat graph is walked both ways
    return pa.table({"node": np.concatenate([a, b]), "link": np.concatenate([b, a])})


def _searched(threshold: float):
    def run(keys: tuple, part: pa.Table) -> pa.Table:
        shard, lo, hi = (k.as_py() for k in keys)
        order = np.argsort(part.column("rep").to_numpy(), kind="stable")
        part = part.take(pa.array(order))
        ids, x = part.column("rep").to_numpy(), unit(matrix(part.column("v")))
        weight, piece = part.column("weight").to_numpy(), part.column("c").to_numpy()
        lists = part.column("links").combine_chunks()
        size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(ids)), size)
        at = np.searchsorted(ids, flat)
        here = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == flat)
        owner, at = owner[here], at[here]
        start = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(ids)))])
        a, b = range_search(x, start, at, threshold)
        dot = dots(x, a, b)
        a, b = a[dot >= threshold], b[dot >= threshold]
        root = local_roots(len(ids), a, b)
        # count a pair in one place: the least common shard, and there the meeting of its two parts
        shards = matrix(part.column("shards"), dtype=np.int64)
        least = least_common(shards, a, b)
        mine = (least == shard) & (np.minimum(piece[a], piece[b]) == lo) & (np.maximum(piece[a], piece[b]) == hi)
        n = np.bincount(a[mine], weight[b[mine]], len(ids)) + np.bincount(b[mine], weight[a[mine]], len(ids))
        keep = (n > 0) | (root != np.arange(len(ids)))
        return pa.table({"rep": ids[keep], "n": n[keep].astype(np.int64), "root": ids[root[keep]]})

    return run


def _link(classes: DataFrame, centres: np.ndarray, overlap: int, width: int, threshold: float) -> DataFrame:
    """``(rep, n, root)``: weights of other classes linked to a class, and a star edge, by shard."""

    def assign(batches):
        for b in batches:
            x = unit(matrix(b.column(1), width))
            near = nearest_centres(x, centres, overlap)
            m = near.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * m, pa.int32()), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=["rep", "v", "weight", "shards"])

    placed = classes.select("rep", "v", "weight").mapInArrow(assign, "rep long, v array<double>, weight long, shards array<int>")
    placed = materialize(placed, "graph")
    each = placed.select("rep", F.explode("shards").alias("shard"))
    hot = each.groupBy("shard").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1")
    hot = materialize(hot, "graph")
    rows = placed.select("rep", "v", "weight", "shards", F.explode("shards").alias("shard")).join(hot, "shard", "left")
    rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("c", F.pmod(F.xxhash64("rep"), F.col("parts").cast("long")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("d"))
    rows = rows.select("shard", F.least("c", "d").alias("lo"), F.greatest("c", "d").alias("hi"), "c", "rep", "v", "weight", "shards", "parts")
    edges = rows.groupBy("shard", "lo", "hi").applyInArrow(_graph, "node long, link long")
    lists = edges.groupBy(F.col("node").alias("rep")).agg(F.collect_set("link").alias("links"))
    full = rows.join(lists, "rep", "left").withColumn("links", F.coalesce("links", F.array().cast("array<bigint>")))
    # a class of neither part is not in the meeting, so links to it are left behind
    met = lambda link: F.pmod(F.xxhash64(link), F.col("parts").cast("long")).isin(F.col("lo").cast("long"), F.col("hi").cast("long"))
    full = full.withColumn("links", F.when(F.col("parts") > 1, F.filter("links", met)).otherwise(F.col("links"))).drop("parts")
    return materialize(full.groupBy("shard", "lo", "hi").applyInArrow(_searched(threshold), "rep long, n long, root long"), "graph")


def audit(classes: DataFrame, counts: DataFrame, width: int, threshold: float, sample: int = AUDIT) -> float:
    """Mean over sampled classes of the share of their true links that were counted (1 if none has a link).

    Classes are drawn by their ids alone, about ``sample`` at a time, whatever was found
    for them, until ``LINKED`` of them truly have links, ``MOST`` are drawn or none is left.
    """
    slices = max(1, -(-classes.count() // sample))
    turn = F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(slices))
    shares, drawn = [], 0
    for i in range(slices):
        some = classes.where(turn == i).select("rep", "v").join(counts, "rep", "left")
        picked = some.select("rep", "v", F.coalesce("n", F.lit(0)).alias("n")).collect()
        if not picked:
            continue
        true = _true_links(classes, picked, width, threshold)
        shares += [min(r["n"], true[j]) / true[j] for j, r in enumerate(picked) if true.get(j)]
        drawn += len(picked)
        if len(shares) >= LINKED or drawn >= MOST:
            break
    return float(np.mean(shares)) if shares else 1.0


def _true_links(classes: DataFrame, picked: list, width: int, threshold: float) -> dict[int, int]:
    """Weights of all other classes in range of each picked one that has any."""
    rep = np.array([r["rep"] for r in picked])
    x = unit(np.array([np.pad(r["v"], (0, width - len(r["v"]))) for r in picked]))

    def met(batches):
        for b in batches:
            n = np.zeros(len(rep), np.int64)
            y, ids, weight = unit(matrix(b.column(1), width)), b.column(0).to_numpy(), b.column(2).to_numpy()
            for lo in range(0, len(ids), _AT_ONCE):
                at = slice(lo, lo + _AT_ONCE)
                hit = (x @ y[at].T >= threshold) & (rep[:, None] != ids[None, at])
                n += hit.astype(np.int64) @ weight[at]
            has = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(n[has])], names=["i", "n"])

    got = classes.select("rep", "v", "weight").mapInArrow(met, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    return {r["i"]: r["n"] for r in got}


def _exact(classes: DataFrame, width: int, threshold: float) -> DataFrame:
    """``(rep, n, root)`` with every pair compared, in meetings of parts of at most about ``PART`` classes."""
    parts = max(1, -(-classes.count() // PART))
    rows = classes.select("rep", "v", "weight", F.pmod(F.xxhash64("rep"), F.lit(parts)).cast("int").alias("c"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("d"))
    rows = rows.select(F.least("c", "d").alias("lo"), F.greatest("c", "d").alias("hi"), "c", "rep", "v", "weight")

    def met(keys: tuple, part: pa.Table) -> pa.Table:
        lo, hi = (k.as_py() for k in keys)
        ids, x = part.column("rep").to_numpy(), unit(matrix(part.column("v"), width))
        weight, c = part.column("weight").to_numpy(), part.column("c").to_numpy()
        n, ends = np.zeros(len(ids), np.int64), []
        for at in range(0, len(ids), _AT_ONCE):
            rows_ = np.arange(at, min(at + _AT_ONCE, len(ids)))
            hit = (x[rows_] @ x.T >= threshold) & (rows_[:, None] != np.arange(len(ids)))
            hit &= (np.minimum(c[rows_, None], c[None, :]) == lo) & (np.maximum(c[rows_, None], c[None, :]) == hi)
            n[rows_] = hit.astype(np.int64) @ weight
            a, b = np.nonzero(hit)
            ends.append((rows_[a], b))
        root = local_roots(len(ids), np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends])) if ends else np.zeros(0, np.int64)
        keep = n > 0
        return pa.table({"rep": ids[keep], "n": n[keep], "root": ids[root[keep]]})

    return materialize(rows.groupBy("lo", "hi").applyInArrow(met, "rep long, n long, root long"), "graph")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``rows``.

    A vector that is null, zero or empty or holds a null or non-finite component links
    with nothing and is kept.  Rows that share an id are vectors of their own; a row
    without an id links like any other, names no component, and is kept only if no other
    row of its component has an id.  Shorter vectors are filled with zeros.  Where the
    graph's recall in the audit stays under ``RECALL`` with every shard overlapping every
    other, all pairs are compared in blocks instead.
    """
    spark = rows.sparkSession
    small_batches(spark)
    every = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    sound = F.coalesce(sound, F.lit(False))
    # scaling by a power of two is exact and keeps squares of huge or tiny components finite
    scaled = F.transform("v", lambda x: x / F.pow(F.lit(2.0), F.floor(F.log2(F.array_max(F.transform("v", F.abs))))))
    keyed = every.withColumn("v", F.when(sound, scaled)).withColumn("key", F.when(sound, F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))))
    keyed = materialize(keyed, "graph")
    classes = keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.first("v").alias("v"), F.count("*").alias("weight"))
    # the number of a class is written with it, once
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("rep"), "key", "id", "v", "weight"), "graph")
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
    n, width = size["n"], size["w"] or 0
    if n:
        drawn = classes.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").toArrow()
        overlap = OVERLAP
        sample = unit(matrix(drawn.column(0), width))
        while True:
            k = min(CENTRES, max(1, -(-n * overlap // SHARD_ROWS)), len(sample))
            linked = _link(classes, centres_of(sample, k), overlap, width, threshold)
            counts = materialize(linked.groupBy("rep").agg(F.sum("n").alias("n")), "graph")
            if audit(classes, counts, width, threshold) >= RECALL:
                break
            if overlap >= k:
                linked = _exact(classes, width, threshold)
                counts = materialize(linked.groupBy("rep").agg(F.sum("n").alias("n")), "graph")
                break
            overlap *= 2
        edges = linked.where("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v"))
        parts = connected_components(edges)
        named = classes.select("key", "id", "rep", "weight").join(counts, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
        links = F.coalesce("n", F.lit(0)) + F.col("weight") - 1
        named = materialize(named.select("key", "id", links.alias("n_links"), F.coalesce("component", "rep").alias("component")), "graph")
        least = named.groupBy("component").agg(F.min("id").alias("component_id"))
        named = named.join(least, "component").select("key", "n_links", "component_id")
    else:
        named = spark.createDataFrame([], "key struct<a:bigint,b:bigint>, n_links long, component_id long")
    out = keyed.select("vec_id", "key").join(named, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for exact links over the embeddings table, components by recursion."""
    return f"""
WITH RECURSIVE base AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
good AS (
  SELECT * FROM base WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= {threshold}),
reach(a, b) AS (SELECT vec_id, vec_id FROM base UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT p.vec_id, coalesce(n, 0) AS n_links, component_id, p.vec_id = component_id AS kept
FROM parts p LEFT JOIN counts c USING (vec_id)
"""
