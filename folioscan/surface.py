"""Named tools over a document set's relations: arguments in, size-bounded JSON out.

A tool is a function from arguments to an ordered DataFrame.  A reply holds as many rows
as fit a number of characters, at least one, and the offset at which to go on.  Errors of
arguments are replies too.
"""

from __future__ import annotations

import difflib
import inspect
import json
import re
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import quantities, search
from folioscan.plans import markups, pagemap, roles

MAX_CHARS = 8000
OPEN_SETS = 8


def fit_rows(df: DataFrame, order: list, budget: int, offset: int = 0) -> DataFrame:
    """The rows from ``offset`` whose compact JSON fits the budget, with ``place`` and ``payload``.

    At least one row is kept.  Only as many rows as the budget has characters are numbered.
    """
    head = df.orderBy(*order).limit(offset + budget)
    numbered = head.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1).where(F.col("place") >= offset)
    rows = numbered.withColumn("payload", F.to_json(F.struct(*df.columns)))
    run = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.length("payload") + 1).over(run) + 2
    return rows.withColumn("__used", used).where((F.col("__used") <= budget) | (F.col("place") == offset)).select("place", "payload")


def scrub_paths(text: str) -> str:
    """Server paths out of messages, their last part kept."""
    return re.sub(r"(?:[A-Za-z]:\\|/)(?:[\w.\- ]+[/\\])+([\w.\-]+)", r"\1", text)


def nearest_name(name: str, known: list[str]) -> str | None:
    return next(iter(difflib.get_close_matches(name, known, 1, 0.6)), None)


def viewer_pages(value: object, shift: int) -> object:
    """Page numbers of a nested reply moved by ``shift`` where their key says page."""
    if isinstance(value, dict):
        return {k: (v + shift if k == "page" and isinstance(v, int) else viewer_pages(v, shift)) for k, v in value.items()}
    return [viewer_pages(v, shift) for v in value] if isinstance(value, list) else value


def resolve_sheets(index: DataFrame, wanted: list[str]) -> DataFrame:
    """``wanted, page, problem`` for printed sheet numbers (P26): unknown ones name a near number, repeated ones are refused."""
    from folioscan.functions.text import normal_number

    spark = index.sparkSession
    ask = spark.createDataFrame([(w,) for w in wanted], "wanted string").withColumn("number", normal_number(F.col("wanted")))
    have = index.where("number is not null").groupBy("number").agg(F.min("page").alias("page"), F.count("*").alias("n"))
    got = ask.join(have, "number", "left")
    near = ask.join(have.select(F.col("number").alias("other")), F.substring("number", 1, 1) == F.substring("other", 1, 1))
    near = near.groupBy("wanted").agg(F.min_by("other", F.struct(F.levenshtein("number", "other").alias("d"), F.col("other"))).alias("near"))
    problem = F.when(F.col("n").isNull(), F.concat(F.lit("no such sheet; nearest "), F.coalesce("near", F.lit("none")))).when(F.col("n") > 1, "two sheets have this number")
    return got.join(near, "wanted", "left").select("wanted", F.when(problem.isNull(), F.col("page")).alias("page"), problem.alias("problem"))


@dataclass
class DocumentSet:
    """The relations a set has: lines, facts, markups."""

    lines: DataFrame
    facts: DataFrame
    markups: DataFrame | None = None
    cache: dict = field(default_factory=dict)

    def summaries(self) -> DataFrame:
        if "summaries" not in self.cache:
            self.cache["summaries"] = pagemap.page_summaries(self.lines, self.facts)
        return self.cache["summaries"]


Tool = Callable[..., tuple[DataFrame, list]]


class Toolkit:
    """Tools by name, over the least recently used ``OPEN_SETS`` document sets."""

    def __init__(self, resolve: Callable[[str], DocumentSet]) -> None:
        self._resolve = resolve
        self._open: OrderedDict[str, DocumentSet] = OrderedDict()
        self.tools: dict[str, Tool] = {
            "document_page_map": self._page_map, "document_structure": self._structure, "search_document": self._search, "find_quantities": self._quantities,
            "document_markups": self._markups, "read_document": self._read, "pages_to_view": self._to_view, "document_duplicates": self._duplicates, "outline": self._outline,
        }

    def open(self, handle: str) -> DocumentSet:
        if handle not in self._open:
            self._open[handle] = self._resolve(handle)
            while len(self._open) > OPEN_SETS:
                self._open.popitem(last=False)
        self._open.move_to_end(handle)
        return self._open[handle]

    def specs(self) -> list[dict]:
        """JSON Schemas of the tools' arguments."""
        kinds = {int: "integer", str: "string", bool: "boolean", float: "number"}
        out = []
        for name, f in self.tools.items():
            args = {}
            required = []
            for p in inspect.signature(f, eval_str=True).parameters.values():
                args[p.name] = {"type": kinds.get(p.annotation, "string")}
                if p.default is p.empty:
                    required.append(p.name)
            out.append({"name": name, "description": inspect.getdoc(f), "input_schema": {"type": "object", "properties": args, "required": required}})
        return out

    def call(self, name: str, arguments: dict | None = None, max_chars: int = MAX_CHARS) -> str:
        """A tool's reply as JSON text: ``items`` and, if there are more, ``next_offset``; or ``error`` and ``hint``."""
        args = dict(arguments or {})
        offset = args.pop("offset", 0)
        if name not in self.tools:
            return json.dumps({"error": f"no tool {name}", "hint": nearest_name(name, list(self.tools))})
        known = inspect.signature(self.tools[name]).parameters
        if wrong := [a for a in args if a not in known]:
            return json.dumps({"error": f"no argument {wrong[0]}", "hint": nearest_name(wrong[0], list(known))})
        try:
            df, order = self.tools[name](**args)
            rows = fit_rows(df, order, max_chars - 40, offset).orderBy("place").collect()
        except (ValueError, TypeError, KeyError) as e:
            return json.dumps({"error": scrub_paths(str(e)), "hint": None})
        reply: dict = {"items": [json.loads(r["payload"]) for r in rows]}
        if rows and not df.orderBy(*order).offset(rows[-1]["place"] + 1).isEmpty():
            reply["next_offset"] = rows[-1]["place"] + 1
        return json.dumps(reply, ensure_ascii=False, separators=(",", ":"))

    def _page_map(self, handle: str, kind: str = "") -> tuple[DataFrame, list]:
        """What every page is."""
        s = self.open(handle).summaries().select("doc_key", "page", "kind", "n_words", "heading", "printed_page", "divider_title")
        return (s.where(F.col("kind") == kind) if kind else s), ["doc_key", "page"]

    def _structure(self, handle: str) -> tuple[DataFrame, list]:
        """The constituent documents."""
        return pagemap.segment_summaries(pagemap.with_segments(self.open(handle).summaries())), ["doc_key", "segment"]

    def _search(self, handle: str, pattern: str, regex: bool = False, case_sensitive: bool = False, fuzzy: bool = False, min_score: float = 80.0) -> tuple[DataFrame, list]:
        """Where a pattern is, exactly or nearly."""
        groups = self.open(handle).lines.select("doc_key", "page", F.col("ord").alias("group_no"), "text")
        if fuzzy:
            return search.fuzzy(groups, pattern, min_score), [F.desc("score"), "doc_key", "page", "group_no"]
        return search.search(groups, pattern, regex, case_sensitive), ["doc_key", "page", "group_no", "start"]

    def _quantities(self, handle: str, kinds: str = "", units: str = "") -> tuple[DataFrame, list]:
        """Stated quantities, by comma-separated kinds and units."""
        split = lambda s: [x.strip() for x in s.split(",") if x.strip()] or None
        got = quantities.mentions(self.open(handle).lines, ["doc_key", "page", "ord"], kinds=split(kinds), units=split(units))
        return got, ["doc_key", "page", "ord", "start"]

    def _markups(self, handle: str, author: str = "") -> tuple[DataFrame, list]:
        """Review markups and their replies."""
        m = self.open(handle).markups
        if m is None:
            raise ValueError("this set has no markups")
        t = markups.threads(markups.by_author(m, author) if author else m)
        return t.select("doc_key", "page", "xref", "kind", "author", "text", "n_replies"), ["doc_key", "page", "xref"]

    def _read(self, handle: str, pages: str = "") -> tuple[DataFrame, list]:
        """The text of pages."""
        d = self.open(handle)
        rows = d.lines.select("doc_key", "page", "ord", "text")
        if pages:
            n = (d.facts.agg(F.max("page").alias("m")).first()["m"] or 0) + 1
            rows = rows.where(F.col("page").isin(pagemap.parse_pages(pages, n)))
        return rows, ["doc_key", "page", "ord"]

    def _to_view(self, handle: str) -> tuple[DataFrame, list]:
        """Pages that must be looked at."""
        return pagemap.to_view(self.open(handle).summaries()), ["doc_key", "page"]

    def _duplicates(self, handle: str) -> tuple[DataFrame, list]:
        """Pages that repeat earlier ones."""
        return pagemap.duplicates(self.open(handle).summaries()), ["doc_key", "page"]

    def _outline(self, handle: str) -> tuple[DataFrame, list]:
        """Entries of tables of contents."""
        return roles.outline_lines(self.open(handle).lines), ["doc_key", "page", "ord"]
