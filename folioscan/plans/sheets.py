"""Sheet index, cross-reference check and schedule check over a set of drawings.

A set's context (which numbers exist, which pages cannot be read) is small next to its
lines; every verdict is an ordered ``CASE`` over equality joins, with "cannot tell" kept
apart from "missing".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import text as T

ALONG, ACROSS = 0.03, 0.012
COVER, DISTINCT, LEAST_SHEETS = 0.5, 0.8, 3


def slots(pieces: DataFrame, sheets: DataFrame) -> DataFrame:
    """Places where a set prints its numbers, best first.

    ``pieces``: ``(doc_key, page, token, rx, ry, size, labelled)``, places relative to the
    page.  Pieces are grouped by cells of the tolerance; a page counts with its largest
    piece.  A slot must cover half the sheets with numbers that are mostly distinct.
    """
    cell = [F.floor(F.col("rx") / ALONG).alias("sx"), F.floor(F.col("ry") / ACROSS).alias("sy")]
    one = pieces.groupBy("doc_key", *cell, "page").agg(F.max_by(F.struct("token", "size", "labelled"), F.struct("size", "token")).alias("p"))
    n = sheets.groupBy("doc_key").agg(F.count("*").alias("n_sheets"))
    slot = one.groupBy("doc_key", "sx", "sy").agg(F.count("*").alias("pages"), F.count_distinct("p.token").alias("tokens"), F.mean(F.col("p.labelled").cast("int")).alias("labelled"), F.mean("p.size").alias("size"))
    slot = slot.join(n, "doc_key").withColumn("cover", F.col("pages") / F.col("n_sheets")).withColumn("distinct", F.col("tokens") / F.col("pages"))
    slot = slot.where((F.col("cover") >= COVER) & (F.col("distinct") >= DISTINCT) & (F.col("pages") >= LEAST_SHEETS))
    score = F.col("cover") * F.col("distinct") * (1 + 0.5 * F.col("labelled")) * (1 + F.least("size", F.lit(48.0)) / 48)
    ranked = slot.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("doc_key").orderBy(F.desc("score"), "sx", "sy")))
    return ranked.withColumn("confidence", F.least(F.lit(0.98), 0.6 + 0.4 * F.col("cover") * F.col("distinct")))


def sheet_index(sheets: DataFrame, pieces: DataFrame) -> DataFrame:
    """``doc_key, page, number, how, confidence`` of every sheet.

    The slot's number, else a label's, else a stand-out size, else the file's page label.
    ``sheets``: ``(doc_key, page, label, median_size)``.
    """
    best = slots(pieces, sheets).where("rank = 1").select("doc_key", "sx", "sy", F.col("confidence").alias("slot_conf"))
    sx, sy = F.floor(F.col("rx") / ALONG), F.floor(F.col("ry") / ACROSS)
    at = pieces.withColumn("sx", sx).withColumn("sy", sy)
    order = F.struct("size", "token")
    slot = at.join(best, ["doc_key", "sx", "sy"]).groupBy("doc_key", "page").agg(F.max_by("token", order).alias("by_slot"), F.max("slot_conf").alias("slot_conf"))
    other = at.join(sheets.select("doc_key", "page", "median_size"), ["doc_key", "page"]).groupBy("doc_key", "page").agg(
        F.max_by("token", F.when(F.col("labelled"), order)).alias("any_label"), F.count_if("labelled").alias("n_label"), F.max_by("token", order).alias("largest"), F.max(F.col("size") / F.col("median_size")).alias("stand_out")
    )
    s = sheets.join(slot, ["doc_key", "page"], "left").join(other, ["doc_key", "page"], "left")
    by_label = F.when(F.col("n_label") > 0, F.col("any_label"))
    by_size = F.when(F.col("stand_out") >= 2, F.col("largest"))
    by_page = F.when(T.is_sheet_number(T.normal_number(F.col("label"))), F.col("label"))
    how = F.when(F.col("by_slot").isNotNull(), "slot").when(by_label.isNotNull(), "label").when(by_size.isNotNull(), "size").when(by_page.isNotNull(), "page_label")
    conf = F.when(how == "slot", F.col("slot_conf")).when(how == "label", 0.75).when(how == "size", 0.5).when(how == "page_label", 0.6)
    return s.select("doc_key", "page", T.normal_number(F.coalesce("by_slot", by_label, by_size, by_page)).alias("number"), how.alias("how"), conf.alias("confidence")).withColumn("number", F.nullif(F.col("number"), F.lit("")))


def duplicate_numbers(index: DataFrame) -> DataFrame:
    """``doc_key, number, n_pages`` of numbers on more than one page."""
    return index.where("number is not null").groupBy("doc_key", "number").agg(F.count_distinct("page").alias("n_pages")).where("n_pages > 1")


def judge(callouts: DataFrame, index: DataFrame, views: DataFrame, unread: DataFrame, lone: DataFrame) -> DataFrame:
    """``callouts`` with ``status`` and ``why`` (J17, X14): resolved, unresolved, not_in_document or cannot_tell.

    ``callouts``: ``(doc_key, page, view, sheet)``; ``views``: ``(doc_key, page, view)``;
    ``unread``: sheets whose text or number cannot be read; ``lone``: unread marks of a sheet.
    """
    sheets = index.where("number is not null").groupBy("doc_key", F.col("number").alias("sheet")).agg(F.count_distinct("page").alias("n_target"), F.min("page").alias("target"))
    dup = duplicate_numbers(index).groupBy("doc_key").agg(F.count("*").alias("n_dup"))
    blind = unread.groupBy("doc_key").agg(F.count("*").alias("n_unread"))
    v = views.groupBy("doc_key", F.col("page").alias("target")).agg(F.collect_set("view").alias("views"))
    l = lone.groupBy("doc_key", F.col("page").alias("target")).agg(F.collect_set("mark").alias("lone"))
    blank = unread.select("doc_key", F.col("page").alias("target"), F.lit(True).alias("no_text")).distinct()
    c = callouts.join(sheets, ["doc_key", "sheet"], "left").join(dup, "doc_key", "left").join(blind, "doc_key", "left")
    c = c.join(v, ["doc_key", "target"], "left").join(l, ["doc_key", "target"], "left").join(blank, ["doc_key", "target"], "left")

    def said(status: str, why: str):
        return F.struct(F.lit(status).alias("status"), F.lit(why).alias("why"))

    none = F.col("target").isNull()
    verdict = (
        F.when(none & (F.coalesce("n_dup", F.lit(0)) > 0), said("cannot_tell", "a sheet number is used twice"))
        .when(none & (F.coalesce("n_unread", F.lit(0)) > 0), said("cannot_tell", "it could be a sheet that is not read"))
        .when(none, said("not_in_document", "no sheet has this number"))
        .when(F.col("n_target") > 1, said("cannot_tell", "two sheets have this number"))
        .when(F.coalesce("no_text", F.lit(False)), said("cannot_tell", "the sheet has no text"))
        .when(F.col("views").isNull(), said("cannot_tell", "no views are recognised on the sheet"))
        .when(F.array_contains("views", F.col("view")), said("resolved", "the view is there"))
        .when(F.coalesce(F.array_contains("lone", F.col("view")), F.lit(False)), said("cannot_tell", "an unread mark equals it"))
        .otherwise(said("unresolved", "the sheet has no such view"))
    )
    return c.withColumn("v", verdict).select(*callouts.columns, "target", "v.status", "v.why")


def unread_marks(lone: DataFrame, views: DataFrame) -> DataFrame:
    """Lone marks of a sheet that are none of its views (U4)."""
    return lone.select("doc_key", "page", F.col("mark")).exceptAll(views.select("doc_key", "page", F.col("view").alias("mark"))).distinct()


def views_over_numbers(numbers: DataFrame, sheets: DataFrame) -> DataFrame:
    """View numbers centred over sheet numbers (J18): ``doc_key, page, sid, vid``, the best fit first, each view once.

    Both: ``(doc_key, page, id, text, x0, y0, x1, y1, size)``; a view's size is 0.9 of the sheet's or more.
    """
    from folioscan.operators.spatial_joins import boxes_meeting, greedy_pairs

    reach = sheets.select("doc_key", "page", F.col("id").alias("sid"), F.col("size").alias("ssize"), F.col("x0").alias("lx0"), (F.col("y0") - 1.5 * (F.col("y1") - F.col("y0")) - 4).alias("ly0"), F.col("x1").alias("lx1"), F.col("y0").alias("ly1"), ((F.col("x0") + F.col("x1")) / 2).alias("smid"), F.col("y0").alias("stop"))
    v = numbers.select("doc_key", "page", F.col("id").alias("vid"), F.col("size").alias("vsize"), *(F.col(c).alias("r" + c) for c in ("x0", "y0", "x1", "y1")))
    pairs = boxes_meeting(reach, v, 50.0, ["doc_key", "page"]).where("sid <> vid")
    off = F.abs((F.col("rx0") + F.col("rx1")) / 2 - F.col("smid"))
    width = F.greatest(F.col("lx1") - F.col("lx0"), F.col("rx1") - F.col("rx0"))
    gap = F.abs(F.col("stop") - F.col("ry1"))
    ok = (off <= F.greatest(F.lit(4.0), 0.35 * width)) & (F.col("ry0") < F.col("stop")) & (F.col("vsize") >= 0.9 * F.col("ssize"))
    scored = pairs.where(ok).select("doc_key", "page", "sid", "vid", (2 * off + gap).alias("dist"))
    return greedy_pairs(scored, ["doc_key", "page"], "sid", "vid").select("doc_key", "page", "sid", "vid")


def schedule_check(rows: DataFrame, marks: DataFrame, unread: DataFrame) -> DataFrame:
    """Schedules against marks, both ways (J19, X15): ``doc_key, mark, side, status``.

    ``rows``: ``(doc_key, schedule, mark)``; ``marks``: ``(doc_key, page, mark)``; ``unread``: sheets
    not read.  A row without a mark may be on an unread sheet; a mark without a row of its
    form cannot be told from another family's; more unlisted marks of a form than rows is
    an unread schedule.
    """
    r = rows.select("doc_key", "mark").distinct().withColumn("form", T.mark_shape(F.col("mark")))
    m = marks.select("doc_key", "mark").distinct().withColumn("form", T.mark_shape(F.col("mark")))
    blind = unread.groupBy("doc_key").agg(F.count("*").alias("n_unread"))
    both = r.select("doc_key", "mark", F.col("form").alias("rform"), F.lit(True).alias("row")).join(m.select("doc_key", "mark", F.col("form").alias("mform"), F.lit(True).alias("seen")), ["doc_key", "mark"], "full")
    both = both.withColumn("form", F.coalesce("rform", "mform")).join(blind, "doc_key", "left")
    by = both.groupBy("doc_key", "form").agg(F.count("row").alias("n_rows"), F.count_if(F.col("row").isNull()).alias("n_unlisted"))
    both = both.join(by, ["doc_key", "form"], "left")
    status = (
        F.when(F.col("row") & F.col("seen"), "listed")
        .when(F.col("seen").isNull() & (F.coalesce("n_unread", F.lit(0)) > 0), "may_be_on_unread_sheet")
        .when(F.col("seen").isNull(), "no_mark")
        .when(F.coalesce("n_rows", F.lit(0)) == 0, "cannot_tell")
        .when(F.col("n_unlisted") > F.col("n_rows"), "cannot_tell")
        .otherwise("no_row")
    )
    side = F.when(F.col("row").isNull(), "mark").otherwise("schedule")
    return both.select("doc_key", "mark", side.alias("side"), status.alias("status"))


def continued_tables(tables: DataFrame) -> DataFrame:
    """``doc_key, page, table_id, continues`` (J22): the first table of a page that goes on with the last of the page before.

    Same columns (two or more), edges within 6 pt, page widths within 1 pt, and the header repeated or said to continue.
    """
    by = Window.partitionBy("doc_key", "page")
    t = tables.withColumn("first", F.row_number().over(by.orderBy("y0", "table_id")) == 1).withColumn("last", F.row_number().over(by.orderBy(F.desc("y0"), F.desc("table_id"))) == 1)
    a = t.where("last").select("doc_key", (F.col("page") + 1).alias("page"), F.col("table_id").alias("continues"), F.col("n_cols").alias("pc"), F.col("x0").alias("px0"), F.col("x1").alias("px1"), F.col("header").alias("ph"), F.col("width").alias("pw"))
    b = t.where("first").join(a, ["doc_key", "page"])
    ok = (F.col("n_cols") == F.col("pc")) & (F.col("n_cols") >= 2) & (F.abs(F.col("x0") - F.col("px0")) <= 6) & (F.abs(F.col("x1") - F.col("px1")) <= 6) & (F.abs(F.col("width") - F.col("pw")) <= 1)
    said = F.col("header").eqNullSafe(F.col("ph")) | F.coalesce(F.col("says_continued"), F.lit(False))
    return b.where(ok & said).select("doc_key", "page", "table_id", "continues")
