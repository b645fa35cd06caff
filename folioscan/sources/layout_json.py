"""Layout-analysis JSON as text lines, words and tables.

Keys may be camelCase or snake_case; polygons are flat lists or lists of points, in
inches or pixels, and are scaled to points of the page.  Parsing is JVM-side, by schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW = 0.8
_WORD = "struct<content:string,confidence:double,polygon:array<double>>"
_LINE = "struct<content:string,polygon:array<double>>"
_PAGE = f"struct<pageNumber:int,width:double,height:double,unit:string,lines:array<{_LINE}>,words:array<{_WORD}>>"
_CELL = "struct<rowIndex:int,columnIndex:int,content:string,kind:string>"
_TABLE = f"struct<rowCount:int,columnCount:int,cells:array<{_CELL}>,boundingRegions:array<struct<pageNumber:int,polygon:array<double>>>>"
RESULT = f"struct<pages:array<{_PAGE}>,tables:array<{_TABLE}>>"
_NAMES = ("page_number", "row_index", "column_index", "row_count", "column_count", "bounding_regions", "analyze_result")


def parsed(files: DataFrame, text_col: str = "value") -> DataFrame:
    """``files`` with ``result``; snake_case keys are read as their camelCase twins, an outer wrapper is taken off."""
    text = F.col(text_col)
    for n in _NAMES:
        head, *rest = n.split("_")
        text = F.replace(text, F.lit(f'"{n}"'), F.lit('"' + head + "".join(w.title() for w in rest) + '"'))
    inner = F.coalesce(F.get_json_object(text, "$.analyzeResult"), text)
    return files.withColumn("result", F.from_json(inner, RESULT))


def _box(polygon: Column, factor: Column) -> list[Column]:
    xs = F.filter(polygon, lambda _, i: i % 2 == 0)
    ys = F.filter(polygon, lambda _, i: i % 2 == 1)
    return [F.array_min(xs) * factor, F.array_min(ys) * factor, F.array_max(xs) * factor, F.array_max(ys) * factor]


def text_lines(files: DataFrame, key: str, width_pt: float = 612.0) -> DataFrame:
    """``key, page, ord, text, x0, y0, x1, y1, source``: lines in points, pages from 0; pixels are scaled by the page's width."""
    p = parsed(files).select(key, F.explode("result.pages").alias("p"))
    factor = F.when(F.col("p.unit") == "inch", 72.0).otherwise(F.lit(width_pt) / F.col("p.width"))
    rows = p.select(key, (F.col("p.pageNumber") - 1).alias("page"), factor.alias("f"), F.posexplode("p.lines").alias("ord", "l"))
    x0, y0, x1, y1 = _box(F.col("l.polygon"), F.col("f"))
    return rows.select(key, "page", "ord", F.col("l.content").alias("text"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), F.lit("layout").alias("source"))


def low_confidence(files: DataFrame, key: str) -> DataFrame:
    """``key, page, n_words, n_low``: words read with less than .8 confidence."""
    p = parsed(files).select(key, F.explode("result.pages").alias("p"))
    low = F.size(F.filter("p.words", lambda w: w["confidence"] < LOW))
    return p.select(key, (F.col("p.pageNumber") - 1).alias("page"), F.size("p.words").alias("n_words"), low.alias("n_low"))


def tables(files: DataFrame, key: str) -> DataFrame:
    """``key, page, table_no, rows, n_cols, n_empty`` with cells in their places, missing ones null."""
    t = parsed(files).select(key, F.posexplode("result.tables").alias("table_no", "t"))

    def row(i: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col("t.columnCount") - 1), lambda j: F.get(F.filter("t.cells", lambda c: (c["rowIndex"] == i) & (c["columnIndex"] == j)), F.lit(0))["content"])

    rows = F.transform(F.sequence(F.lit(0), F.col("t.rowCount") - 1), row)
    out = t.select(key, (F.col("t.boundingRegions")[0]["pageNumber"] - 1).alias("page"), "table_no", rows.alias("rows"), F.col("t.columnCount").alias("n_cols"))
    empty = F.aggregate("rows", F.lit(0), lambda a, r: a + F.size(F.filter(r, lambda c: c.isNull() | (F.trim(c) == ""))))
    return out.withColumn("n_empty", empty)


def ranked_text(channels: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Lines of the first text source in ``order`` that covers a page."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("source")).cast("int")
    best = channels.groupBy(*keys).agg(F.min(rank).alias("__best"))
    return channels.join(best, keys).where(rank == F.col("__best")).drop("__best")
