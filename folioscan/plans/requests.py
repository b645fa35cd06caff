"""Requests to mark a copy, stored viewports and dimension markups, and what refuses them.

Nothing is written over a source: a request becomes a row of the copy or a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import units as U
from folioscan.functions.geometry import path_length

KINDS = ("text", "callout", "box", "cloud", "highlight", "note")


def resolved(requests: DataFrame, pages: DataFrame, quotes: DataFrame) -> DataFrame:
    """``request_id, page, x0, y0, x1, y1, anchor, refused`` of requests to mark (K1).

    An anchor is a quote found once on its page, a box inside the page, or a reply; a
    quote found twice or never, an unknown kind, or a box off the page is refused with
    the reason.
    """
    found = requests.where("quote is not null").join(quotes, ["doc_key", "page", "quote"]).groupBy("request_id").agg(F.count("*").alias("n_quote"), F.first(F.struct("qx0", "qy0", "qx1", "qy1")).alias("q"))
    r = requests.join(pages.select("doc_key", "page", "width", "height"), ["doc_key", "page"], "left").join(found, "request_id", "left")
    inside = (F.col("x0") >= 0) & (F.col("y0") >= 0) & (F.col("x1") <= F.col("width")) & (F.col("y1") <= F.col("height")) & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))
    n = F.coalesce("n_quote", F.lit(0))
    why = (
        F.when(~F.col("kind").isin(*KINDS), "no such kind of markup")
        .when(F.col("width").isNull(), "no such page")
        .when(F.col("reply_to").isNotNull(), None)
        .when(F.col("quote").isNotNull() & (n == 0), "the quote is not on the page")
        .when(F.col("quote").isNotNull() & (n > 1), "the quote is there more than once")
        .when(F.col("quote").isNull() & ~F.coalesce(inside, F.lit(False)), "the box is not on the page")
    )
    anchor = F.when(why.isNotNull(), None).when(F.col("reply_to").isNotNull(), "reply").when(F.col("quote").isNotNull(), "quote").otherwise("box")
    at = [F.when(anchor == "quote", F.col(f"q.q{c}")).when(anchor == "box", F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")]
    return r.select("request_id", "page", *at, anchor.alias("anchor"), why.alias("refused"))


def after_edits(written: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The marks of a copy after removals by id and additions; a mark added again keeps its first place (K3)."""
    kept = written.join(removed, "uid", "left_anti").withColumn("gen", F.lit(0))
    every = kept.unionByName(added.withColumn("gen", F.lit(1)))
    return every.withColumn("n", F.row_number().over(Window.partitionBy("uid").orderBy("gen"))).where("n = 1").drop("n", "gen")


def parsed_viewports(objects: DataFrame) -> DataFrame:
    """``doc_key, page, ratio, x_per_point, x_unit, x0, y0, x1, y1`` from the text of PDF measure dictionaries."""
    t = F.col("object")

    def num(key: str) -> Column:
        return F.nullif(F.regexp_extract(t, rf"/{key}\s+(-?[0-9]*\.?[0-9]+)", 1), F.lit("")).cast("double")

    box = F.transform(F.split(F.trim(F.regexp_extract(t, r"/BBox\s*\[([^\]]*)\]", 1)), r"\s+"), lambda v: v.try_cast("double"))
    ratio = F.nullif(F.trim(F.regexp_extract(t, r"/R\s*\(([^)]*)\)", 1)), F.lit(""))
    unit = F.nullif(F.regexp_extract(t, r"/X\s*\[\s*<<[^>]*/U\s*\(([^)]*)\)", 1), F.lit(""))
    ok = F.size(box) == 4
    edge = lambda f, a, b: F.when(ok, f(F.get(box, F.lit(a)), F.get(box, F.lit(b))))
    return objects.select("doc_key", "page", ratio.alias("ratio"), num("C").alias("x_per_point"), U.normal_unit(unit).alias("x_unit"), edge(F.least, 0, 2).alias("x0"), edge(F.least, 1, 3).alias("y0"), edge(F.greatest, 0, 2).alias("x1"), edge(F.greatest, 1, 3).alias("y1"))


def dimension_measures(markups: DataFrame, tol: float = 0.02) -> DataFrame:
    """What a dimension markup states and what its vertices say (S22): ``xref, stated_ft, derived_ft, ratio, agrees``.

    ``markups``: ``(xref, contents, vertices, per_point, unit)``; one without a factor derives nothing.
    """
    side = U.parse_ratio(F.concat(F.lit("1 ft = "), F.trim("contents")))
    stated = U.convert_length(side["real_len"], F.coalesce(side["real_unit"], F.lit("?")), F.lit("ft"))
    derived = U.convert_length(path_length(F.col("vertices"), F.lit(False)) * F.col("per_point"), F.col("unit"), F.lit("ft"))
    out = markups.select("xref", stated.alias("stated_ft"), derived.alias("derived_ft"))
    ratio = F.when(F.col("derived_ft") > 0, F.col("stated_ft") / F.col("derived_ft"))
    return out.withColumn("ratio", ratio).withColumn("agrees", F.abs(F.col("ratio") - 1) <= tol)


def boxes_in_answer(answers: DataFrame, text_col: str = "answer") -> DataFrame:
    """Boxes in a reader's free text on the 0-999 grid (F24): ``answer_id, ord, frame, x0, y0, x1, y1``.

    A box may be tagged px, pt or grid; px needs the view's size, pt its clip from the origin.
    """
    found = F.regexp_extract_all(F.col(text_col), F.lit(r"(?:px|pt|grid)?\s*\[\s*-?[0-9.]+(?:\s*,\s*-?[0-9.]+){3}\s*\]"), F.lit(0))
    rows = answers.select("answer_id", "width_px", "height_px", "width_pt", "height_pt", F.posexplode(found).alias("ord", "b"))
    frame = F.coalesce(F.nullif(F.regexp_extract("b", r"^(px|pt|grid)", 1), F.lit("")), F.lit("grid"))
    v = F.transform(F.split(F.regexp_replace("b", r"[^0-9.,\-]", ""), ","), lambda x: x.try_cast("double"))
    w = F.when(frame == "px", F.col("width_px")).when(frame == "pt", F.col("width_pt"))
    h = F.when(frame == "px", F.col("height_px")).when(frame == "pt", F.col("height_pt"))
    to = lambda k, size: F.when(frame == "grid", v[k]).otherwise(v[k] / size * 999)
    return rows.select("answer_id", "ord", frame.alias("frame"), to(0, w).alias("x0"), to(1, h).alias("y0"), to(2, w).alias("x1"), to(3, h).alias("y1"))
