"""Queries of image budgets, tiles, hashes and paged replies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from folioscan import derive, surface
from folioscan.functions import images as I
from folioscan.plans import sheets
from folioscan.queries.sets import index
from folioscan.registry import query

SEG = derive.with_sql("segment")


@query(
    """WITH p AS (SELECT p_partkey, 100::DOUBLE + p_size * 10 AS w, 200::DOUBLE + p_partkey % 300 AS h FROM part), c AS (SELECT p_partkey, w, h, unnest(range(1, 1025)) AS n FROM p),
f AS (SELECT *, greatest(1, floor(n * least(w, h) / greatest(w, h)))::INT AS m FROM c), k AS (SELECT p_partkey, any_value(w) AS w, any_value(h) AS h, max(n) AS n FROM f WHERE n <= 1024 AND m <= 768 AND ceil(n / 32) * ceil(m / 32) <= 600 GROUP BY 1),
r AS (SELECT *, greatest(1, floor(n * least(w, h) / greatest(w, h)))::INT AS m FROM k) SELECT p_partkey, CASE WHEN w >= h THEN n ELSE m END::INT AS px_w, CASE WHEN w >= h THEN m ELSE n END::INT AS px_h FROM r"""
)
def g17_fit_size(spark, sf_dir):
    p = derive.table(spark, sf_dir, "part")
    size = I.fit_size(100.0 + F.col("p_size") * 10, 200.0 + F.col("p_partkey") % 300, F.lit(1024), F.lit(768), F.lit(32), F.lit(600))
    return p.select("p_partkey", size.alias("s")).select("p_partkey", F.col("s.w").alias("px_w"), F.col("s.h").alias("px_h"))


@query("SELECT p_partkey, 768 * (p_size / 10::DOUBLE) / 14 AS side_pt, CASE WHEN p_size >= 12 THEN 1 ELSE greatest(1, least(6, ceil(16 / greatest(p_size, 0.1)))) END::INT AS n FROM part")
def p28_legibility(spark, sf_dir):
    s = F.col("p_size")
    return derive.table(spark, sf_dir, "part").select("p_partkey", I.legible_window(s / 10, F.lit(768)).alias("side_pt"), I.tiles_per_side(s.cast("double")).alias("n"))


@query("SELECT s_suppkey, k, greatest(0, (k % 3) * 200 - 16)::DOUBLE AS x0, greatest(0, (k // 3) * 100 - 8)::DOUBLE AS y0, least(600, (k % 3 + 1) * 200 + 16)::DOUBLE AS x1, least(300, (k // 3 + 1) * 100 + 8)::DOUBLE AS y1 FROM supplier, range(9) t(k)")
def g18_tiles(spark, sf_dir):
    boxes = I.tile_boxes(F.lit(0.0), F.lit(0.0), F.lit(600.0), F.lit(300.0), F.lit(3))
    t = derive.table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(boxes).alias("k", "b"))
    return t.select("s_suppkey", F.col("k").cast("long").alias("k"), *(F.round(f"b.{c}", 9).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("WITH h AS (SELECT doc_id, md5(text) AS h FROM documents) SELECT a.doc_id, bit_count(('0x' || substr(a.h, 1, 8))::BIGINT # ('0x' || substr(b.h, 1, 8))::BIGINT)::INT AS d FROM h a JOIN h b ON b.doc_id = a.doc_id + 1".replace("('0x' || substr(a.h, 1, 8))::BIGINT # ('0x' || substr(b.h, 1, 8))::BIGINT", "xor(('0x' || substr(a.h, 1, 8))::BIGINT, ('0x' || substr(b.h, 1, 8))::BIGINT)"))
def g19_hamming(spark, sf_dir):
    h = derive.table(spark, sf_dir, "documents").select("doc_id", F.substring(F.md5("text"), 1, 8).alias("h"))
    return h.join(h.select((F.col("doc_id") - 1).alias("doc_id"), F.col("h").alias("g")), "doc_id").select("doc_id", I.hamming(F.col("h"), F.col("g")).alias("d"))


def _grids(spark, sf_dir):
    """Grey grids of 48 by 48: a mark of each vector's bits, repeated at four places."""
    e = derive.table(spark, sf_dir, "embeddings").where("vec_id < 60").select("vec_id", "embedding")

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for i, v in zip(b["vec_id"], b["embedding"]):
                g = np.full((48, 48), 255, np.uint8)
                mark = np.where(np.asarray(v).reshape(8, 8) > 0, 0, 255).astype(np.uint8)
                for y, x in ((4, 4), (4, 30), (30, 4), (30, 30)):
                    g[y : y + 8, x : x + 8] = mark
                rows.append((i, 48, 48, g.tobytes()))
            yield pd.DataFrame(rows, columns=["vec_id", "height", "width", "pixels"])

    return e.mapInPandas(run, "vec_id long, height int, width int, pixels binary")


@query()
def g19_difference_hashes(spark, sf_dir):
    return I.hashes(_grids(spark, sf_dir), ["vec_id"])


@query()
def x24_find_like(spark, sf_dir):
    first = derive.table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]
    mark = np.where(np.asarray(first).reshape(8, 8) > 0, 0, 255).astype(np.uint8)
    return I.find_like(_grids(spark, sf_dir), ["vec_id"], mark)


@query("WITH r AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS place, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS payload FROM nation), u AS (SELECT *, sum(length(payload) + 1) OVER (ORDER BY place) + 2 AS used FROM r WHERE place >= 3) SELECT place::INT AS place, payload FROM u WHERE used <= 300 OR place = 3")
def k6_o6_paged_rows(spark, sf_dir):
    n = derive.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return surface.fit_rows(n, ["n_nationkey"], 300, 3)


@query("WITH i AS (SELECT 'A-' || (p_partkey % 400) AS number, min(p_partkey)::INT AS page, count(*) AS n FROM part WHERE p_partkey % 23 <> 0 GROUP BY 1) SELECT 'a-' || k AS wanted, CASE WHEN n = 1 THEN page END AS page FROM range(1, 60) t(k) LEFT JOIN i ON number = 'A-' || k")
def p26_sheet_addresses(spark, sf_dir):
    return surface.resolve_sheets(index(spark, sf_dir), [f"a-{k}" for k in range(1, 60)]).drop("problem")


@query(
    """WITH r AS (SELECT s_suppkey AS k, x, y FROM supplier, LATERAL (SELECT s_suppkey * 20 AS x, 100 AS y)) SELECT 'd' AS doc_key, 0 AS page, 2 * k AS sid, 2 * k + 1 AS vid FROM r WHERE k % 3 <> 0"""
)
def j18_views_over_numbers(spark, sf_dir):
    k = F.col("s_suppkey")
    s = derive.table(spark, sf_dir, "supplier")
    base = [F.lit("d").alias("doc_key"), F.lit(0).alias("page")]
    nums = s.select(*base, (2 * k).alias("id"), (k * 20.0).alias("x0"), F.lit(100.0).alias("y0"), (k * 20.0 + 16).alias("x1"), F.lit(110.0).alias("y1"), F.lit(8.0).alias("size"))
    over = s.select(*base, (2 * k + 1).alias("id"), (k * 20.0 + 5).alias("x0"), F.lit(88.0).alias("y0"), (k * 20.0 + 12).alias("x1"), F.lit(98.0).alias("y1"), F.when(k % 3 == 0, 5.0).otherwise(9.0).alias("size"))
    return sheets.views_over_numbers(over, nums)
