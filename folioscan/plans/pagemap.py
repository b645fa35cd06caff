"""The page map: what each page is, what it prints, and which pages form one document.

Pages are reduced to one row by grouped aggregation on ``(doc_key, page)``; everything
that looks at the previous page is one window over a document's pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import text as T

LARGE, TABLOID = 250.0, 150.0
FORM_RULES = 12
DUPLICATE_WORDS = 15


def page_kind(area: Column, chars: Column, cad_chars: Column, paths: Column, coverage: Column, optical: Column, rules_h: Column, rules_v: Column) -> Column:
    """``struct(kind, rule, needs_ocr)`` by ordered rules (P7).  ``area`` is in square inches, ``chars`` without CAD text."""
    every = chars + cad_chars
    image_only = (coverage >= 0.5) & F.when(optical, paths < 50).otherwise(every < 50)

    def is_(kind: str, rule: Column | str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (rule if isinstance(rule, Column) else F.lit(rule)).alias("rule"))

    # The sentence of each rule.
    seen = F.when(optical, "mostly image, text read optically").otherwise("mostly image, no text layer")
    out = (
        F.when((every < 5) & (paths < 5) & (coverage < 0.02), is_("blank", "no text, linework or images"))
        .when((area >= LARGE) & ((paths >= 200) | (coverage >= 0.5) | (cad_chars > 0)), is_("drawing_sheet", "large format with linework/images"))
        .when(image_only, is_("scanned", seen))
        .when((rules_h >= FORM_RULES) & (rules_v >= FORM_RULES), is_("form", "ruled grid in both directions"))
        .when((every < 1500) & ((paths >= 300) | (coverage >= 0.35)), is_("figure", "heavy graphics, modest text"))
        .when((every >= 600) & (paths < 300) & (coverage < 0.35), is_("text", "text-dense, light graphics"))
        .otherwise(is_("mixed", "no single dominant content type"))
    )
    return F.struct(out["kind"].alias("kind"), out["rule"].alias("rule"), (image_only & ~optical).alias("needs_ocr"))


def text_statistics(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """One row a page: characters, words, words outside the bands, bands, heading, key texts."""
    keyed = lines.join(facts.select("doc_key", "page", "height"), ["doc_key", "page"])
    top = F.col("y1") <= T.BAND * F.col("height")
    bottom = ~top & (F.col("y0") >= (1 - T.BAND) * F.col("height"))
    n = T.words(F.col("text"))
    order = F.struct(F.bround(F.col("y0") / 4).alias("row"), F.col("ord"), F.col("text"))

    def band(cond: Column) -> Column:
        texts = F.transform(F.array_sort(F.collect_list(F.when(cond, order))), lambda s: s["text"])
        return F.when(F.size(texts) > 0, F.array_join(texts, " | "))

    in_order = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return keyed.groupBy("doc_key", "page").agg(
        F.sum(F.length("text")).alias("n_chars"), F.sum(n).alias("n_words"), F.sum(F.when(top | bottom, 0).otherwise(n)).alias("body_words"), F.count("*").alias("n_lines"),
        F.sum(F.length("text") - F.length(F.replace(F.col("text"), F.lit("�"), F.lit("")))).alias("n_unmapped"),
        band(top).alias("header"), band(bottom).alias("footer"),
        F.max_by("text", F.struct("size", (-F.col("ord")).alias("o"))).alias("heading"), F.transform(in_order, lambda s: s["text"]).alias("texts"),
    )


def text_size(lines: DataFrame, quantile: float = 0.25, least_chars: int = 40) -> DataFrame:
    """``(doc_key, page, text_size)``: the character-weighted quantile of line heights of 2 pt or more.

    The first height at which the running weight reaches its share; null under ``least_chars``.
    """
    rows = lines.withColumn("h", F.col("y1") - F.col("y0")).withColumn("w", F.length("text"))
    rows = rows.where(F.col("h") >= 2).groupBy("doc_key", "page", "h").agg(F.sum("w").alias("w"))
    by = Window.partitionBy("doc_key", "page")
    rows = rows.withColumn("run", F.sum("w").over(by.orderBy("h"))).withColumn("all", F.sum("w").over(by))
    reached = F.min(F.when(F.col("run") >= quantile * F.col("all"), F.col("h")))
    return rows.groupBy("doc_key", "page").agg(F.when(F.max("all") >= least_chars, reached).alias("text_size"))


def page_summaries(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """The page map's row for each page, pages without a line included."""
    s = facts.join(text_statistics(lines, facts), ["doc_key", "page"], "left")
    for c in ("n_chars", "n_words", "body_words", "n_lines", "n_unmapped"):
        s = s.withColumn(c, F.coalesce(c, F.lit(0)))
    area = F.col("width") / 72 * (F.col("height") / 72)
    s = s.withColumn("area", area).withColumn("k", page_kind(area, F.col("n_chars"), F.col("n_cad_chars"), F.col("n_vector_paths"), F.col("image_coverage"), F.col("optical"), F.col("ruling_h"), F.col("ruling_v")))
    texts = F.coalesce("texts", F.array().cast("array<string>"))
    bands = F.concat_ws(" ", F.coalesce("header", F.lit("")), F.coalesce("footer", F.lit("")))
    unreliable = F.when(F.col("n_chars") > 0, F.col("n_unmapped") / F.col("n_chars") > T.UNRELIABLE).otherwise(False)
    printed = T.printed_page(bands)
    return s.select(
        "doc_key", "page", "width", "height", "area", F.col("k.kind").alias("kind"), F.col("k.rule").alias("rule"), (F.col("k.needs_ocr") | unreliable).alias("needs_ocr"),
        (~unreliable).alias("text_reliable"), "n_chars", "n_words", "body_words", "n_lines", (F.col("n_words") / area).alias("words_per_in2"), "header", "footer",
        F.substring("heading", 1, 120).alias("heading"), printed["page"].alias("printed_page"), printed["of"].alias("printed_of"), T.sheet_count(bands).alias("sheet_count"),
        T.divider_title(F.col("heading"), F.col("n_words"), texts).alias("divider_title"), T.content_key(F.col("k.kind"), F.col("n_vector_paths"), texts).alias("content_key"), "image_coverage",
    )


def with_segments(summaries: DataFrame) -> DataFrame:
    """``summaries`` with ``segment``, the number of the constituent document from 0."""
    by = Window.partitionBy("doc_key").orderBy("page")
    s = summaries.withColumn("hk", T.running_key(F.col("header"))).withColumn("fk", T.running_key(F.col("footer")))
    s = s.withColumn("cls", F.when(F.col("area") >= LARGE, 2).when(F.col("area") >= TABLOID, 1).otherwise(0)).withColumn("sheet", F.col("kind") == "drawing_sheet")
    was = {c: F.lag(c).over(by) for c in ("hk", "fk", "cls", "sheet", "printed_page")}
    same = T.same_running(F.col("hk"), was["hk"]) | T.same_running(F.col("fk"), was["fk"])
    keyed, keyed_before = (F.col("hk") != "") | (F.col("fk") != ""), (was["hk"] != "") | (was["fk"] != "")
    restart = F.coalesce((F.col("printed_page") == 1) & (was["printed_page"] != 1), F.lit(False))
    new = (
        F.when(was["cls"].isNull(), True)
        .when(F.col("divider_title").isNotNull(), True)
        .when(F.col("cls") != was["cls"], True)
        .when(F.col("sheet") != was["sheet"], True)
        .when(F.col("sheet"), False)
        .when(restart & ~same, True)
        .when(keyed & ~same, True)
        .when(~keyed & keyed_before & (F.col("kind") != "blank"), True)
        .otherwise(False)
    )
    return s.withColumn("new", new.cast("int")).withColumn("segment", (F.sum("new").over(by) - 1).cast("int")).drop("new", "cls", "sheet")


def modal(value: Column, first: Column, keys: list[str], df: DataFrame, name: str) -> DataFrame:
    """The most frequent value of each group, ties to the one seen first."""
    counts = df.where(value.isNotNull()).groupBy(*keys, value.alias(name)).agg(F.count("*").alias("n"), F.min(first).alias("first"))
    return counts.groupBy(*keys).agg(F.max_by(name, F.struct("n", (-F.col("first")).alias("f"))).alias(name))


def segment_summaries(pages: DataFrame) -> DataFrame:
    """One row a segment: range, title, modal header, kinds, printed range."""
    keys = ["doc_key", "segment"]
    base = pages.groupBy(*keys).agg(
        F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("n_pages"), F.min("printed_page").alias("printed_from"), F.max("printed_page").alias("printed_to"),
        F.min_by("divider_title", "page").alias("divider"), F.min_by("heading", "page").alias("head"), F.min((F.col("kind") == "drawing_sheet").cast("int")).alias("all_sheets"),
    )
    out = base.join(modal(F.col("kind"), F.col("page"), keys, pages, "main_kind"), keys)
    keyed = modal(F.when(F.col("header").isNotNull(), F.col("hk")), F.col("page"), keys, pages, "key")
    header = pages.join(keyed, keys).where(F.col("hk") == F.col("key")).groupBy(*keys).agg(F.min_by("header", "page").alias("header"))
    out = out.join(header, keys, "left")
    bare = F.btrim(F.regexp_replace(F.regexp_replace("header", r"(?i)\bpage\s+[0-9]{1,4}(?:\s+of\s+[0-9]{1,4})?\b", ""), r"(?i)\bsheet\s+[0-9]{1,3}\s+of\s+[0-9]{1,3}\b", ""), F.lit(" |"))
    title = F.coalesce("divider", F.when(F.col("all_sheets") == 1, "Drawing sheets"), F.when(bare != "", bare), "head", "main_kind")
    return out.select(*keys, "first_page", "last_page", "n_pages", F.substring(title, 1, 100).alias("title"), "main_kind", "header", "printed_from", "printed_to")


def duplicates(summaries: DataFrame) -> DataFrame:
    """``(doc_key, page, duplicate_of)``: pages whose words repeat an earlier page's (X11, A5).

    The text rule needs words of the page's own; blank pages never are duplicates.
    """
    by = Window.partitionBy("doc_key", "content_key", F.bround("width", 1), F.bround("height", 1))
    s = summaries.where((F.col("body_words") >= DUPLICATE_WORDS) & (F.col("kind") != "blank"))
    s = s.withColumn("duplicate_of", F.min("page").over(by))
    return s.where(F.col("duplicate_of") < F.col("page")).select("doc_key", "page", "duplicate_of")


def image_duplicates(pages: DataFrame, radius: int = 2) -> DataFrame:
    """``(doc_key, page, duplicate_of, distance)`` of pages with near-equal picture hashes.

    ``pages``: ``(doc_key, page, kind, width, height, hash)``, hash a 64-bit long.  Hashes within
    ``radius`` bits agree in one of ``radius + 1`` bands, so bands are the join keys.
    """
    size = 64 // (radius + 1)
    bands = F.array(*(F.struct(F.lit(i).alias("b"), F.shiftrightunsigned("hash", i * size).bitwiseAND(F.lit((1 << size) - 1)).alias("v")) for i in range(radius + 1)))
    keyed = pages.select("doc_key", "kind", F.bround("width", 1).alias("w"), F.bround("height", 1).alias("h"), "page", "hash", F.explode(bands).alias("band"))
    later, earlier = keyed.alias("a"), keyed.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("doc_key", "kind", "w", "h", "band")]
    near = F.bit_count(F.col("a.hash").bitwiseXOR(F.col("b.hash")))
    pairs = later.join(earlier, [*same, F.col("b.page") < F.col("a.page")]).select("a.doc_key", "a.page", F.col("b.page").alias("other"), near.alias("distance")).where(F.col("distance") <= radius)
    first = pairs.groupBy("doc_key", "page").agg(F.min(F.struct("other", "distance")).alias("m"))
    return first.select("doc_key", "page", F.col("m.other").alias("duplicate_of"), F.col("m.distance").alias("distance"))


def boilerplate(lines: DataFrame, facts: DataFrame, pages_least: int = 3, chars_least: int = 4) -> DataFrame:
    """``(doc_key, masked, n_pages)``: band lines, digits masked, that three pages print."""
    keyed = lines.join(facts.select("doc_key", "page", "height"), ["doc_key", "page"])
    bands = keyed.where((F.col("y1") <= T.BAND * F.col("height")) | (F.col("y0") >= (1 - T.BAND) * F.col("height")))
    masked = bands.select("doc_key", "page", F.lower(T.mask_digits(T.squeeze(F.col("text")))).alias("masked")).where(F.length("masked") >= chars_least)
    return masked.distinct().groupBy("doc_key", "masked").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= pages_least)


def advice(summaries: DataFrame) -> DataFrame:
    """``(doc_key, page, advice)``, one row for each thing that a page's text cannot give."""
    kind = F.col("kind")
    said = F.array(
        F.when((kind == "scanned") & F.col("needs_ocr"), "no text layer: view it or attach OCR"),
        F.when((kind == "scanned") & ~F.col("needs_ocr"), "text read optically: view it to confirm"),
        F.when(kind == "drawing_sheet", "labels in drafting order: view the sheet"),
        F.when(kind == "form", "cells in drafting order: view the page"),
        F.when(kind == "figure", "labels of a figure: view the page"),
        F.when((kind == "mixed") & (F.col("image_coverage") >= 0.2), "images are not in the text: view them"),
        F.when(~F.col("text_reliable"), "text layer unreliable: do not quote it"),
    )
    return summaries.select("doc_key", "page", F.explode(F.array_compact(said)).alias("advice"))


def to_view(summaries: DataFrame) -> DataFrame:
    """Pages that must be looked at, and whether they can be searched at all."""
    look = F.col("kind").isin("scanned", "drawing_sheet", "form", "figure") | ~F.col("text_reliable") | F.col("needs_ocr")
    return summaries.where(look).select("doc_key", "page", "kind", (~F.col("needs_ocr")).alias("searchable"))


def page_ranges(pages: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``ranges``, such as "0-2,5", of each group's distinct pages."""
    by = Window.partitionBy(*keys).orderBy("page")
    runs = pages.select(*keys, "page").distinct().withColumn("g", F.col("page") - F.row_number().over(by))
    runs = runs.groupBy(*keys, "g").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    shown = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    ordered = F.array_sort(F.collect_list(F.struct("a", shown.alias("s"))))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda r: r["s"]), ",").alias("ranges"))


def parse_pages(spec: object, n_pages: int) -> list[int]:
    """0-based pages of ``None`` (all), an int, a list or text such as "0-4,9" (S2).

    A page out of range, or text that names no page, is an error that says what is valid.
    """
    if spec is None:
        return list(range(n_pages))
    if isinstance(spec, bool):
        raise ValueError("pages are numbers")
    if isinstance(spec, int):
        got = [spec]
    elif isinstance(spec, str):
        got = []
        for part in filter(None, (p.strip() for p in spec.split(","))):
            a, dash, b = part.partition("-")
            try:
                first, last = int(a), int(b) if dash else int(a)
            except ValueError:
                raise ValueError(f"cannot read pages {part!r}; write 0-4,9") from None
            if last < first:
                raise ValueError(f"range {part!r} runs backwards")
            got += range(first, last + 1)
    else:
        got = [int(p) for p in spec]
    for p in got:
        if not 0 <= p < n_pages:
            raise ValueError(f"page {p} is outside 0-{n_pages - 1}")
    return list(dict.fromkeys(got))
