"""Reading order, text that a set repeats, and what stands near what."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.operators.ordered import joined_pieces
from folioscan.operators.spatial_joins import nearest_within

SPANNING, COLUMN_LINES, GAP_HEIGHTS, MOST_COLUMNS = 0.6, 4, 0.6, 4


def gutters(lines: DataFrame) -> DataFrame:
    """``doc_key, page, gutter``: the x of gaps between columns of prose.

    Lines wider than .6 of the page span columns and are left out; a gap counts if it is
    .6 line heights wide and four lines end left and four begin right of it; at most three.
    """
    narrow = lines.where(F.col("x1") - F.col("x0") <= SPANNING * F.col("width"))
    keys = ["doc_key", "page"]
    merged = joined_pieces(narrow.select(*keys, F.col("x0").alias("lo"), F.col("x1").alias("hi")), keys, 0.0)
    by = Window.partitionBy(*keys).orderBy("lo")
    gap = merged.withColumn("next", F.lead("lo").over(by)).withColumn("left", F.sum("n").over(by)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    h = narrow.groupBy(*keys).agg(F.percentile(F.col("y1") - F.col("y0"), 0.5).alias("h"))
    gap = gap.join(h, keys).where((F.col("next") - F.col("hi") >= GAP_HEIGHTS * F.col("h")) & (F.col("left") >= COLUMN_LINES) & (F.col("all") - F.col("left") >= COLUMN_LINES))
    gap = gap.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.col("next") - F.col("hi")), "hi"))).where(F.col("rank") < MOST_COLUMNS)
    return gap.select(*keys, ((F.col("hi") + F.col("next")) / 2).alias("gutter"))


def column_order(lines: DataFrame) -> DataFrame:
    """``lines`` with ``column`` (null for a line across a gutter) and ``place`` in the reading order by columns.

    A line across a gutter is a break: the columns above it are read first.
    """
    keys = ["doc_key", "page"]
    g = gutters(lines).groupBy(*keys).agg(F.array_sort(F.collect_list("gutter")).alias("g"))
    l = lines.join(g, keys, "left").withColumn("g", F.coalesce("g", F.array().cast("array<double>")))
    across = F.exists("g", lambda x: (F.col("x0") < x) & (F.col("x1") > x))
    col = F.size(F.filter("g", lambda x: x <= (F.col("x0") + F.col("x1")) / 2))
    l = l.withColumn("column", F.when(~across, col))
    mid = (F.col("y0") + F.col("y1")) / 2
    breaks = F.sum(F.col("column").isNull().cast("int")).over(Window.partitionBy(*keys).orderBy(mid, "ord").rowsBetween(Window.unboundedPreceding, -1))
    l = l.withColumn("__b", 2 * F.coalesce(breaks, F.lit(0)) + F.col("column").isNull().cast("int"))
    order = Window.partitionBy(*keys).orderBy("__b", F.coalesce("column", F.lit(0)), "y0", "x0", "ord")
    return l.withColumn("place", F.row_number().over(order) - 1).drop("__b", "g")


def repeated_texts(lines: DataFrame, share: float = 0.6, least: int = 3) -> DataFrame:
    """``doc_key, text, n_pages`` of texts on most pages of a set."""
    pages = lines.groupBy("doc_key").agg(F.count_distinct("page").alias("n"))
    t = lines.select("doc_key", "page", "text").distinct().groupBy("doc_key", "text").agg(F.count("*").alias("n_pages"))
    return t.join(pages, "doc_key").where(F.col("n_pages") >= F.greatest(F.lit(least), share * F.col("n"))).drop("n")


def repeated_hits(hits: DataFrame, pages: DataFrame, cell: float = 10.0, share: float = 0.6, least: int = 3) -> DataFrame:
    """``hits`` with ``on_sheets``, the same-size pages with a hit at the same place, and ``repeats``."""
    at = [F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")]
    size = ["doc_key", "width", "height"]
    n = pages.groupBy(*size).agg(F.count("*").alias("n_same"))
    h = hits.join(pages, ["doc_key", "page"]).select("*", *at)
    seen = h.groupBy(*size, "cx", "cy").agg(F.count_distinct("page").alias("on_sheets"))
    out = h.join(seen, [*size, "cx", "cy"]).join(n, size)
    return out.withColumn("repeats", F.col("on_sheets") >= F.greatest(F.lit(float(least)), share * F.col("n_same"))).select(*hits.columns, "on_sheets", "repeats")


def near_text(entities: DataFrame, texts: DataFrame, radius: float, keys: list[str] = ()) -> DataFrame:
    """``keys, id, near``: the closest text of every entity within a radius."""
    e = entities.select(*keys, "id", F.col("x").alias("lx"), F.col("y").alias("ly"))
    t = texts.select(*keys, "text", F.col("x").alias("rx"), F.col("y").alias("ry"))
    hit = nearest_within(e, t, radius, list(keys), F.col("text"))
    return e.join(hit, [*keys, "lx", "ly"]).groupBy(*keys, "id").agg(F.min_by("near.tie", "near").alias("near"))


def rendered(lines: DataFrame) -> DataFrame:
    """Lines as a reader gets them, with id and box (K7)."""
    b = F.concat_ws(",", *(F.bround(c).cast("long").cast("string") for c in ("x0", "y0", "x1", "y1")))
    tag = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit(".t"), F.col("ord").cast("string"), F.lit(" @ "), b)
    return lines.select("doc_key", "page", "ord", F.concat(F.lit("["), tag, F.lit("] "), F.col("text")).alias("line"))


def stated_and_measured(stated: DataFrame, measured: DataFrame, keys: list[str], tol: float = 0.05) -> DataFrame:
    """Stated spacings against measured ones of the same unit (X30): ``keys, value, units, measured, agrees``; null where nothing is measured."""
    m = measured.select(*keys, F.col("units"), F.col("value").alias("measured"))
    out = stated.join(m, [*keys, "units"], "left")
    gap = F.try_divide(F.abs(F.col("value") - F.col("measured")), "measured")
    return out.withColumn("agrees", gap <= tol).select(*keys, "value", "units", "measured", "agrees")
