"""Document relations derived from the driver tables, and the same in DuckDB SQL.

The driver tables hold no drawings, so pages, lines, points and boxes are derived from
their columns by fixed arithmetic.  A binder of fifty documents is one document of
fifty pages.  ``SQL`` has a common table expression for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions.text import strip
from folioscan.storage import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page facts with the page's text."""
    i = F.col("doc_id")
    big, tabloid = i % 7 == 3, i % 11 == 5
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.floor(i / 50).cast("string")).alias("doc_key"),
        (i % 50).cast("int").alias("page"),
        F.when(i % 17 == 4, F.concat(F.lit("APPENDIX "), F.chr(65 + i % 26))).otherwise(F.col("text")).alias("text"),
        F.when(i % 5 != 0, F.concat(F.lit("Report "), F.col("source"), F.lit(" | Page "), (i % 9 + 1).cast("string"), F.lit(" of 9"))).alias("header_text"),
        F.when(big, 2592.0).when(tabloid, 1224.0).otherwise(612.0).alias("width"),
        F.when(big, 1728.0).otherwise(792.0).alias("height"),
        ((i * 37) % 400).cast("int").alias("n_vector_paths"),
        (((i * 13) % 100) / 100).alias("image_coverage"),
        (i % 16).cast("int").alias("ruling_h"),
        ((i * 3) % 17).cast("int").alias("ruling_v"),
        F.when(i % 13 == 0, 40).otherwise(0).alias("n_cad_chars"),
        (i % 6 == 1).alias("optical"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines: an optional header in the top band, then the body's lines that are not blank."""
    p = pages(spark, sf_dir)
    rows = p.select("doc_key", "page", "height", F.size(F.split("text", "\n")).alias("n"), F.posexplode(F.split("text", "\n")).alias("ord", "raw"))
    y = F.col("height") * 0.1 + F.col("height") * 0.9 * F.col("ord") / F.col("n")
    body = rows.select("doc_key", "page", "ord", strip(F.col("raw")).alias("text"), y.alias("y0"), (y + F.col("height") * 0.9 / F.col("n") * 0.8).alias("y1")).where("text <> ''")
    head = p.where("header_text is not null").select("doc_key", "page", F.lit(-1).alias("ord"), F.col("header_text").alias("text"), F.lit(10.0).alias("y0"), F.lit(20.0).alias("y1"))
    return body.unionByName(head).withColumn("size", 8.0 + F.length("text") % 9)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pid, cls, sheet, x, y)`` with coordinates on a tenth of a unit, on three sheets."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), F.col("label").alias("cls"), (F.col("vec_id") % 3).alias("sheet"), *((F.floor(e[k].cast("double") * 1000) / 10.0).alias(c) for k, c in ((0, "x"), (1, "y"))))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, layer, sheet, color, kind, ax, ay, ex, ey, x0, y0, x1, y1)``: drawn segments and their boxes, on three sheets."""
    e = F.col("embedding")
    at = [(F.floor(e[k].cast("double") * 1000) / 10.0).alias(c) for k, c in enumerate(("ax", "ay", "ex", "ey"))]
    s = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("layer"), (F.col("vec_id") % 3).alias("sheet"), F.when(F.col("vec_id") % 3 == 0, "#FF0000").otherwise("#000000").alias("color"), F.when(F.col("vec_id") % 4 == 0, "polyline").otherwise("line").alias("kind"), *at)
    return s.select("*", F.least("ax", "ex").alias("x0"), F.least("ay", "ey").alias("y0"), F.greatest("ax", "ex").alias("x1"), F.greatest("ay", "ey").alias("y1"))


def markups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of review markups: a turn replies to the turn before it."""
    c = F.col("conv_id")
    x, y = (c * 7 + F.col("turn") * 11) % 500, (c * 13 + F.col("turn") * 5) % 700
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("d"), F.floor(c / 20).cast("string")).alias("doc_key"), (c % 20).cast("int").alias("page"), (c * 100 + F.col("turn")).alias("xref"),
        F.when(F.col("turn") > 0, c * 100 + F.col("turn") - 1).alias("irt_xref"), F.col("role").alias("author"), F.col("text"),
        F.element_at(F.array(*map(F.lit, ("FreeText", "Stamp", "Text"))), (c % 3 + 1).cast("int")).alias("kind"),
        x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + 40 + c % 90).cast("double").alias("x1"), (y + 20 + c % 50).cast("double").alias("y1"),
        (x + 30).cast("double").alias("tip_x"), (y + 10).cast("double").alias("tip_y"), F.col("turn"),
    )


#: DuckDB common table expressions of the same relations.
SQL = {
    "page": """page AS (
  SELECT 'd' || (doc_id // 50) AS doc_key, (doc_id % 50)::INT AS page,
         CASE WHEN doc_id % 17 = 4 THEN 'APPENDIX ' || chr((65 + doc_id % 26)::INT) ELSE text END AS text,
         CASE WHEN doc_id % 5 <> 0 THEN 'Report ' || source || ' | Page ' || (doc_id % 9 + 1) || ' of 9' END AS header_text,
         CASE WHEN doc_id % 7 = 3 THEN 2592 WHEN doc_id % 11 = 5 THEN 1224 ELSE 612 END::DOUBLE AS width,
         CASE WHEN doc_id % 7 = 3 THEN 1728 ELSE 792 END::DOUBLE AS height,
         ((doc_id * 37) % 400)::INT AS n_vector_paths, ((doc_id * 13) % 100)::DOUBLE / 100 AS image_coverage,
         (doc_id % 16)::INT AS ruling_h, ((doc_id * 3) % 17)::INT AS ruling_v,
         CASE WHEN doc_id % 13 = 0 THEN 40 ELSE 0 END AS n_cad_chars, doc_id % 6 = 1 AS optical
  FROM documents)""",
    "line": """raw_line AS (
  SELECT doc_key, page, height, len(string_split(text, chr(10))) AS n, unnest(string_split(text, chr(10))) AS raw,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM page),
line AS (
  SELECT *, 8::DOUBLE + length(text) % 9 AS size FROM (
    SELECT doc_key, page, ord::INT AS ord, trim(raw) AS text, height * 0.1::DOUBLE + height * 0.9::DOUBLE * ord / n AS y0,
           height * 0.1::DOUBLE + height * 0.9::DOUBLE * ord / n + height * 0.9::DOUBLE / n * 0.8::DOUBLE AS y1
    FROM raw_line WHERE trim(raw) <> ''
    UNION ALL SELECT doc_key, page, -1, header_text, 10::DOUBLE, 20::DOUBLE FROM page WHERE header_text IS NOT NULL))""",
    "point": """point AS (
  SELECT vec_id AS pid, label AS cls, vec_id % 3 AS sheet, floor(embedding[1]::DOUBLE * 1000) / 10::DOUBLE AS x, floor(embedding[2]::DOUBLE * 1000) / 10::DOUBLE AS y
  FROM embeddings)""",
    "segment": """bare_segment AS (
  SELECT vec_id AS id, 'L' || label AS layer, vec_id % 3 AS sheet, CASE WHEN vec_id % 3 = 0 THEN '#FF0000' ELSE '#000000' END AS color,
         CASE WHEN vec_id % 4 = 0 THEN 'polyline' ELSE 'line' END AS kind,
         floor(embedding[1]::DOUBLE * 1000) / 10::DOUBLE AS ax, floor(embedding[2]::DOUBLE * 1000) / 10::DOUBLE AS ay,
         floor(embedding[3]::DOUBLE * 1000) / 10::DOUBLE AS ex, floor(embedding[4]::DOUBLE * 1000) / 10::DOUBLE AS ey FROM embeddings),
segment AS (
  SELECT *, least(ax, ex) AS x0, least(ay, ey) AS y0, greatest(ax, ex) AS x1, greatest(ay, ey) AS y1 FROM bare_segment)""",
    "markup": """markup AS (
  SELECT 'd' || (conv_id // 20) AS doc_key, (conv_id % 20)::INT AS page, conv_id * 100 + turn AS xref,
         CASE WHEN turn > 0 THEN conv_id * 100 + turn - 1 END AS irt_xref, role AS author, text,
         ['FreeText', 'Stamp', 'Text'][conv_id % 3 + 1] AS kind,
         ((conv_id * 7 + turn * 11) % 500)::DOUBLE AS x0, ((conv_id * 13 + turn * 5) % 700)::DOUBLE AS y0,
         ((conv_id * 7 + turn * 11) % 500 + 40 + conv_id % 90)::DOUBLE AS x1, ((conv_id * 13 + turn * 5) % 700 + 20 + conv_id % 50)::DOUBLE AS y1,
         ((conv_id * 7 + turn * 11) % 500 + 30)::DOUBLE AS tip_x, ((conv_id * 13 + turn * 5) % 700 + 10)::DOUBLE AS tip_y, turn
  FROM conversations)""",
}


def with_sql(*names: str) -> str:
    """``WITH`` and the named expressions; a query follows after a comma or directly."""
    return "WITH " + ",\n".join(SQL[n] for n in names)
