"""Page roles, sections, work items, outline and ledger."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions.search import phrase_pattern
from folioscan.operators.ordered import carried, islands


@dataclass(frozen=True)
class Cue:
    """Words that speak for a role; decisive in a title, or if strong and of weight 8 or more."""

    role: str
    phrases: tuple[str, ...]
    weight: int
    strong: bool = False


CUES = (
    Cue("boring_log", ("boring log", "log of boring", "test pit log", "borehole log"), 10, True),
    Cue("lab_test", ("grain size", "sieve analysis", "atterberg limits", "triaxial", "consolidation test"), 8, True),
    Cue("letter", ("dear", "sincerely", "yours truly"), 6),
    Cue("contents", ("table of contents", "list of figures", "list of tables"), 9, True),
    Cue("calculation", ("calculation", "factor of safety", "design load"), 5),
    Cue("plan", ("site plan", "location plan", "key plan"), 7),
    Cue("photo", ("photograph", "photo"), 4),
)
ITEM_OF = {"boring_log": "log", "lab_test": "test", "calculation": "calculation", "letter": "letter", "plan": "drawing", "photo": "photos"}


def cue_roles(pages: DataFrame, cues: tuple[Cue, ...] = CUES) -> DataFrame:
    """``pages`` (with ``title`` and ``body``) and ``cue, cue_weight, decisive``: the heaviest cue, earlier cues first."""
    hits = []
    for k, c in enumerate(cues):
        pat = phrase_pattern(list(c.phrases))
        in_title, in_body = F.coalesce(F.col("title"), F.lit("")).rlike(pat), F.coalesce(F.col("body"), F.lit("")).rlike(pat)
        hit = F.struct((F.lit(c.weight) + in_title.cast("int") * 5).alias("w"), F.lit(-k).alias("k"), F.lit(c.role).alias("role"), (in_title | F.lit(c.strong and c.weight >= 8)).alias("decisive"))
        hits.append(F.when(in_title | in_body, hit))
    best = F.array_max(F.array_compact(F.array(*hits)))
    return pages.withColumn("__b", best).withColumn("cue", F.col("__b.role")).withColumn("cue_weight", F.col("__b.w")).withColumn("decisive", F.coalesce("__b.decisive", F.lit(False))).drop("__b")


def sections(dividers: DataFrame) -> DataFrame:
    """``doc_key, first_page, last_page, title, letter, level``: what each divider opens.

    A stack of documents: a divider whose letter comes next in the outer sequence closes
    an appended report that ran its own A, B, C.  ``dividers``: ``(doc_key, page, title, n_pages)``.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("page")
        stack: list[list] = [[None]]
        rows = []
        for r in pdf.itertuples():
            m = re.match(r"(?i)(?:appendix|attachment|exhibit|annex|enclosure)\s+([A-Z])\b", r.title or "")
            letter = m[1].upper() if m else None
            if letter:
                nxt = [k for k in range(len(stack) - 1, -1, -1) if stack[k][-1] and ord(stack[k][-1]) + 1 == ord(letter)]
                if nxt:
                    del stack[nxt[0] + 1 :]
                    stack[-1][-1] = letter
                elif letter == "A" and stack[-1][-1] is not None:
                    stack.append(["A"])
                else:
                    stack[-1][-1] = letter
            rows.append((r.doc_key, int(r.page), int(r.n_pages) - 1, r.title, letter, len(stack) - 1))
        ends = [row[1] - 1 for row in rows[1:]] + [rows[-1][2]] if rows else []
        out = [(d, p, e, t, l, v) for (d, p, _, t, l, v), e in zip(rows, ends)]
        return pd.DataFrame(out, columns=["doc_key", "first_page", "last_page", "title", "letter", "level"])

    return dividers.groupBy("doc_key").applyInPandas(run, "doc_key string, first_page int, last_page int, title string, letter string, level int")


def assign(pages: DataFrame) -> DataFrame:
    """``pages`` with ``role`` and ``why``, by precedence (W6): appended, blank, divider, front matter, decisive cue, section's tab, cue, shape."""

    def said(role: Column | str, why: str) -> Column:
        return F.struct((role if isinstance(role, Column) else F.lit(role)).alias("role"), F.lit(why).alias("why"))

    shape = F.when(F.col("kind").isin("drawing_sheet", "figure"), "figure").when(F.col("kind") == "text", "narrative").otherwise("other")
    got = (
        F.when(F.col("appended"), said("appended_report", "inside an appended report"))
        .when(F.col("kind") == "blank", said("blank", "nothing on the page"))
        .when(F.col("divider_title").isNotNull(), said("divider", "a divider page"))
        .when((F.col("page") == 0) & (F.col("n_words") <= 120), said("cover", "a short first page"))
        .when(F.col("decisive"), said(F.col("cue"), "decisive words"))
        .when(F.col("tab_role").isNotNull(), said(F.col("tab_role"), "its section's tab"))
        .when(F.col("cue").isNotNull(), said(F.col("cue"), "words on the page"))
        .otherwise(said(shape, "the page's shape"))
    )
    return pages.withColumn("__r", got).withColumn("role", F.col("__r.role")).withColumn("why", F.col("__r.why")).drop("__r")


def smooth(pages: DataFrame) -> DataFrame:
    """Untitled sheets after a log page take its role at .7 (W3): ``pages`` with ``smoothed``.

    Eligible are undecided pages that are no divider and have five log fields, or three and "page N of M".
    """
    loose = F.col("role").isin("other", "figure") & ((F.col("log_fields") >= 5) | (F.col("printed_of").isNotNull() & (F.col("log_fields") >= 3)))
    out = carried(pages, ["doc_key"], ["page"], "role", loose, F.col("role") == "boring_log", "__c")
    return out.withColumn("smoothed", F.when(loose & F.col("__c").isNotNull(), F.col("__c")).otherwise(F.col("role"))).drop("__c")


def items(pages: DataFrame, role: str = "role") -> DataFrame:
    """Work items (W2): ``doc_key, kind, key, first_page, last_page``.

    Consecutive pages of one kind; a changed key or "page 1 of M" opens another; pages of
    no kind break.
    """
    kind = F.create_map(*(F.lit(x) for kv in ITEM_OF.items() for x in kv))[F.col(role)]
    by = Window.partitionBy("doc_key").orderBy("page")
    p = pages.withColumn("k", kind).withColumn("pk", F.lag("k").over(by)).withColumn("last_key", F.last("item_key", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    changed = F.col("item_key").isNotNull() & (F.col("item_key") != F.coalesce("last_key", F.col("item_key")))
    starts = ~F.col("k").eqNullSafe(F.col("pk")) | changed | ((F.col("printed_page") == 1) & F.col("printed_of").isNotNull())
    run = islands(p, ["doc_key"], ["page"], starts).where("k is not null")
    return run.groupBy("doc_key", "island").agg(F.first("k").alias("kind"), F.min("item_key").alias("key"), F.min("page").alias("first_page"), F.max("page").alias("last_page")).drop("island")


def ledger(pages: DataFrame) -> DataFrame:
    """One line a page."""
    line = F.concat_ws(" ", F.format_string("%4d", "page"), F.rpad("kind", 13, " "), F.rpad("role", 12, " "), F.substring(F.coalesce("heading", F.lit("")), 1, 100))
    return pages.select("doc_key", "page", F.rtrim(line).alias("line"))


def outline_lines(lines: DataFrame) -> DataFrame:
    """Entries of a table of contents (F25): ``doc_key, page, ord, number, title, printed_page``; roman and lettered pages stay text."""
    pat = r"^\s*((?:[0-9]+(?:\.[0-9]+)*|[A-Z])\.?\s+)?(\S.*?)\s*(?:\.\s?){3,}\s*([0-9]{1,4}|[ivxlc]{1,6}|[A-Z]-?[0-9]{1,3})\s*$"
    t = F.col("text")
    number = F.regexp_replace(F.trim(F.regexp_extract(t, pat, 1)), r"\.$", "")
    return lines.where(t.rlike(pat)).select("doc_key", "page", "ord", F.nullif(number, F.lit("")).alias("number"), F.regexp_extract(t, pat, 2).alias("title"), F.regexp_extract(t, pat, 3).alias("printed_page"))


def placed_outline(entries: DataFrame, headings: DataFrame) -> DataFrame:
    """Entries with ``target`` where exactly one heading matches and printed numbers agree, else null."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")))
    e = entries.withColumn("k", norm(F.col("title")))
    h = headings.select("doc_key", norm(F.col("heading")).alias("k"), F.col("page").alias("hp"), F.col("printed_page").cast("string").alias("pp"))
    hits = e.join(h, ["doc_key", "k"], "left").where("hp is null or hp <> page")
    ok = hits.where(F.col("hp").isNotNull() & (F.col("pp").isNull() | (F.col("pp") == F.col("printed_page"))))
    one = ok.groupBy("doc_key", "page", "ord").agg(F.min("hp").alias("target"), F.count_distinct("hp").alias("n")).where("n = 1").drop("n")
    return entries.join(one, ["doc_key", "page", "ord"], "left")
