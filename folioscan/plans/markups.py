"""Review markups: threads, what they aim at, duplicates, hidden and overprinted text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import geometry as G
from folioscan.operators.spatial_joins import boxes_meeting, points_in_boxes

_CORNERS = ("x0", "y0", "x1", "y1")


def by_author(markups: DataFrame, part: str) -> DataFrame:
    return markups.where(F.contains(F.lower("author"), F.lit(part.lower())))


def threads(markups: DataFrame) -> DataFrame:
    """``markups`` with ``n_replies`` and ``replies``, from the reply links of a page."""
    replies = markups.where("irt_xref is not null").groupBy("doc_key", "page", F.col("irt_xref").alias("xref")).agg(F.count("*").alias("n_replies"), F.array_sort(F.collect_list("xref")).alias("replies"))
    out = markups.join(replies, ["doc_key", "page", "xref"], "left")
    return out.withColumn("n_replies", F.coalesce("n_replies", F.lit(0))).withColumn("replies", F.coalesce("replies", F.array().cast("array<bigint>")))


def aimed_at(markups: DataFrame, cell: float = 200.0) -> DataFrame:
    """``doc_key, page, xref, target``: the smallest other markup a tip lies in.

    A reply relative is no target, nor is a markup drawn later.
    """
    tips = markups.select("doc_key", "page", "xref", "irt_xref", F.col("tip_x").alias("px"), F.col("tip_y").alias("py"), F.col("turn").alias("drawn"))
    boxes = markups.select("doc_key", "page", F.col("xref").alias("other"), F.col("irt_xref").alias("other_irt"), F.col("turn").alias("other_drawn"), *_CORNERS)
    hits = points_in_boxes(tips, boxes, cell, ["doc_key", "page"])
    related = F.coalesce(F.col("irt_xref") == F.col("other"), F.lit(False)) | F.coalesce(F.col("other_irt") == F.col("xref"), F.lit(False))
    hits = hits.where((F.col("xref") != F.col("other")) & ~related & (F.col("other_drawn") <= F.col("drawn")))
    return hits.groupBy("doc_key", "page", "xref").agg(F.min_by("other", F.struct(G.area(G.box()).alias("a"), F.col("other"))).alias("target"))


def duplicate_marks(written: DataFrame, cell: float = 200.0) -> DataFrame:
    """``doc_key, page, xref, duplicate_of`` (K2): same kind and wording, more than half the smaller box shared; replies exempt."""
    own = written.where("irt_xref is null")
    says = F.lower(F.trim(F.regexp_replace(F.col("text"), r"\s+", " ")))
    a = own.select("doc_key", "page", "kind", says.alias("says"), "xref", *(F.col(c).alias("l" + c) for c in _CORNERS))
    b = own.select("doc_key", "page", "kind", says.alias("says"), F.col("xref").alias("earlier"), *(F.col(c).alias("r" + c) for c in _CORNERS))
    hits = boxes_meeting(a, b, cell, ["doc_key", "page", "kind", "says"]).where("earlier < xref")
    hits = hits.where(G.overlap_of_smaller(G.box("l"), G.box("r")) > 0.5)
    return hits.groupBy("doc_key", "page", "xref").agg(F.min("earlier").alias("duplicate_of"))


def hidden_only(cad: DataFrame, layer: DataFrame, least: float = 0.3, cell: float = 200.0) -> DataFrame:
    """Hidden strings that the text layer does not already show at an overlap of ``least``."""
    says = F.lower(F.regexp_replace(F.col("text"), r"\s+", ""))
    a = cad.withColumn("says", says).select("doc_key", "page", "says", "id", *(F.col(c).alias("l" + c) for c in _CORNERS))
    b = layer.withColumn("says", says).select("doc_key", "page", "says", *(F.col(c).alias("r" + c) for c in _CORNERS))
    shown = boxes_meeting(a, b, cell, ["doc_key", "page", "says"]).where(G.iou(G.box("l"), G.box("r")) >= least)
    return cad.join(shown.select("doc_key", "page", "id").distinct(), ["doc_key", "page", "id"], "left_anti")


def without_overprints(lines: DataFrame, tol: float = 0.5) -> DataFrame:
    """Lines less those drawn again within ``tol`` of the same text already on the page."""
    keyed = lines.select("doc_key", "page", "text", F.col("ord").alias("later"), F.col("x0").alias("lx"), F.col("y0").alias("ly"))
    other = lines.select("doc_key", "page", "text", F.col("ord").alias("earlier"), F.col("x0").alias("rx"), F.col("y0").alias("ry"))
    from folioscan.operators.spatial_joins import cell, reached

    a = keyed.withColumn("cx", cell(F.col("lx"), 10.0)).withColumn("cy", cell(F.col("ly"), 10.0))
    b = other.withColumn("cx", F.explode(reached(F.col("rx") - tol, F.col("rx") + tol, 10.0))).withColumn("cy", F.explode(reached(F.col("ry") - tol, F.col("ry") + tol, 10.0)))
    near = a.join(b, ["doc_key", "page", "text", "cx", "cy"]).where((F.col("earlier") < F.col("later")) & (F.abs(F.col("lx") - F.col("rx")) <= tol) & (F.abs(F.col("ly") - F.col("ry")) <= tol))
    again = near.select("doc_key", "page", F.col("later").alias("ord")).distinct()
    return lines.join(again, ["doc_key", "page", "ord"], "left_anti")


def channels(lines: DataFrame, cad: DataFrame, markups: DataFrame) -> DataFrame:
    """All that can be searched on a page, by channel (U1): ``doc_key, page, channel, item, text``."""
    said = F.concat_ws(" | ", "text", "author")
    a = lines.select("doc_key", "page", F.lit("line").alias("channel"), F.col("ord").cast("long").alias("item"), "text")
    b = cad.select("doc_key", "page", F.lit("cad").alias("channel"), F.col("id").cast("long").alias("item"), "text")
    c = markups.select("doc_key", "page", F.lit("markup").alias("channel"), F.col("xref").cast("long").alias("item"), said.alias("text"))
    return a.unionByName(b).unionByName(c)


def unique_ids(markups: DataFrame, uid: str = "uid") -> DataFrame:
    """``markups`` with the later of equal ids suffixed."""
    n = F.row_number().over(Window.partitionBy("doc_key", uid).orderBy("xref"))
    return markups.withColumn(uid, F.when(n > 1, F.concat(uid, F.lit("-"), n.cast("string"))).otherwise(F.col(uid)))


def anchor_problem(width: float = 300.0, share: float = 0.25, most: float = 0.95):
    """Why a box read off a view cannot anchor a markup, else null (P25)."""
    w, view = F.col("x1") - F.col("x0"), F.col("view_width")
    return F.when(w >= most * view, "the box is the whole view").when((w > width) & (w > share * view), "the box is too wide to point at anything")
