"""Exact, folded and forgiving search, with spans in the characters of the page."""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks that read the same.
SAME = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "′": "'", "“": '"', "”": '"', "„": '"', "″": '"', "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "×": "x", "⁄": "/", "…": "..."}
CONTEXT = 60


@functools.cache
def _plain(c: str) -> str:
    """What one character folds to."""
    kept = (d for d in unicodedata.normalize("NFKD", SAME.get(c, c)) if not unicodedata.combining(d) and d != "\u00ad")
    return "".join(" " if e.isspace() else e for d in kept for e in SAME.get(d, d))


def fold(text: str) -> tuple[str, list[int]]:
    """Folded text and, for each of its characters and its end, the offset in the original (F2).

    Compatibility forms are decomposed, accents dropped, look-alike punctuation made
    plain, and runs of white space one space.
    """
    parts = list(map(_plain, text))
    whole = "".join(parts)
    if "  " not in whole and set(map(len, parts)) <= {1}:  # letter for letter
        return whole, list(range(len(text) + 1))
    out: list[str] = []
    at: list[int] = []
    for i, part in enumerate(parts):
        for e in part:
            if e == " " and out and out[-1] == " ":
                continue
            out.append(e)
            at.append(i)
    at.append(len(text))
    return "".join(out), at


def readings(text: str, line_ends: list[int]) -> list[tuple[str, list[int]]]:
    """A text with its line-end hyphens as printed, closed up, and dropped, each with offsets.

    ``line_ends``: offsets of the characters that join two printed lines.
    """
    out = [(text, list(range(len(text) + 1)))]
    broken = [i for i in line_ends if 0 < i < len(text) and text[i - 1] == "-"]
    if broken:
        for drop in ({i for i in broken}, {j for i in broken for j in (i, i - 1)}):
            keep = [i for i in range(len(text)) if i not in drop]
            out.append(("".join(text[i] for i in keep), [*keep, len(text)]))
    return out


def find_spans(text: str, pattern: str, regex: bool, case: bool, line_ends: list[int] = ()) -> list[tuple[int, int]]:
    """Every distinct span of the pattern, in original offsets, sorted (F1)."""
    body = pattern if regex else re.escape(fold(pattern)[0].strip())
    if not body:
        return []
    try:
        rx = re.compile(body, 0 if case else re.I)
    except re.error as e:
        raise ValueError(f"not a regular expression: {e}") from None
    spans = set()
    for read, back in readings(text, list(line_ends)):
        folded, at = fold(read)
        for m in rx.finditer(folded):
            if m.end() > m.start():
                spans.add((back[at[m.start()]], back[at[m.end() - 1]] + 1))
    return sorted(spans)


def snippet(text: str, start: int, end: int, around: int = CONTEXT) -> str:
    """The match with its surroundings, ellipses where text is left out."""
    a, b = max(0, start - around), min(len(text), end + around)
    return ("…" if a else "") + text[a:b] + ("…" if b < len(text) else "")


def search(groups: DataFrame, pattern: str, regex: bool = False, case: bool = False) -> DataFrame:
    """``doc_key, page, group_no, start, end, matched, snippet`` of every hit.

    ``groups``: ``(doc_key, page, group_no, text)`` and optionally ``line_ends``.  Rows that
    cannot hold a literal are left out before any text reaches Python.
    """
    find_spans("", pattern, regex, case)
    rows = groups
    if not regex and pattern.isascii() and pattern.isalnum():
        # a literal of letters and digits survives folding, unless a line end breaks it or it carries accents
        plain = F.lower(F.regexp_replace(F.col("text"), r"[\s\-]+", ""))
        rows = rows.where(F.contains(plain, F.lit(pattern.lower())) | ~F.col("text").rlike(r"^\p{ASCII}*$"))
    if "line_ends" not in rows.columns:
        rows = rows.withColumn("line_ends", F.array().cast("array<int>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hits = []
            for d, p, g, t, ends in zip(b["doc_key"], b["page"], b["group_no"], b["text"], b["line_ends"]):
                for s, e in find_spans(t or "", pattern, regex, case, list(ends) if ends is not None else []):
                    hits.append((d, p, g, s, e, t[s:e], snippet(t, s, e)))
            yield pd.DataFrame(hits, columns=["doc_key", "page", "group_no", "start", "end", "matched", "snippet"])

    return rows.select("doc_key", "page", "group_no", "text", "line_ends").mapInPandas(run, "doc_key string, page int, group_no int, start int, end int, matched string, snippet string")


def contains_literal(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines that hold a literal, any case, with its first place: the fast path of `search` on plain text."""
    at = F.locate(pattern.lower(), F.lower("text"))
    s = F.lit(len(pattern))
    snip = F.substring(F.col("text"), F.greatest(at - CONTEXT, F.lit(1)), s + 2 * CONTEXT - F.greatest(F.lit(CONTEXT + 1) - at, F.lit(0)))
    return lines.where(at > 0).select("doc_key", "page", "ord", (at - 1).alias("start"), snip.alias("snippet"))


def first_hits(hits: DataFrame, order: list, most: int) -> DataFrame:
    """The first hits in document order and whether there were more."""
    return hits.withColumn("__n", F.row_number().over(Window.orderBy(*order))).where(F.col("__n") <= most + 1).withColumn("truncated", F.max("__n").over(Window.partitionBy()) > most).where(F.col("__n") <= most).drop("__n")


def _common(masks: dict[str, int], n: int, text: str) -> int:
    """Length of the longest common subsequence with a query of ``n`` characters, by bit-parallel rows."""
    full = (1 << n) - 1
    row = full
    for c in text:
        u = row & masks.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def _masks(query: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(query):
        out[c] = out.get(c, 0) | 1 << i
    return out


def similarity(a: str, b: str) -> float:
    """0 to 100: twice the longest common subsequence over both lengths."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    return 200.0 * _common(_masks(a), len(a), b) / (len(a) + len(b))


def partial_similarity(query: str, text: str, least: float = 0.0) -> tuple[float, int, int]:
    """The best alignment of the query in a text, ``(score, start, end)``; a shorter text is scored whole.

    Windows of the query's length are tried where a character of it can begin.  A window gains
    at most one common character a step, so those that cannot pass the best so far, or reach
    ``least``, are stepped over; a score under ``least`` may be given as 0.
    """
    n = len(query)
    if len(text) <= n:
        return (similarity(query, text) if 200.0 * len(text) >= least * (n + len(text)) else 0.0), 0, len(text)
    masks, best = _masks(query), (0.0, 0, n)
    need, i = max(1, math.ceil(least * n / 100 - 1e-6)), 0
    while i <= len(text) - n and need <= n:
        if text[i] not in masks:
            i += 1
            continue
        got = _common(masks, n, text[i : i + n])
        if got >= need:
            best, need = (100.0 * got / n, i, i + n), got + 1
        i += need - got
    return best


def pairs_needed(query: str, cutoff: float) -> int:
    """How many of a query's distinct letter pairs any text that reaches the cutoff must hold.

    A text that reaches it lacks at most ``k`` characters of the query and puts at most ``j``
    others between them; a lacking one breaks two pairs, another one pair.
    """
    n = len(query)
    k, j = int(n * (1 - cutoff / (200 - cutoff))), int(n * (1 - cutoff / 100))
    return max(0, len({query[i : i + 2] for i in range(n - 1)}) - 2 * k - j)


def fuzzy(groups: DataFrame, query: str, cutoff: float = 80.0) -> DataFrame:
    """``doc_key, page, group_no, score, start, end`` of groups that hold something like the query.

    Groups that are too short, or with too few of the query's letter pairs (`pairs_needed`),
    cannot reach the cutoff and are left out by an expression before any text reaches Python.
    """
    folded = fold(query)[0].strip().lower()
    pairs = sorted({folded[i : i + 2] for i in range(len(folded) - 1)})
    need = pairs_needed(folded, cutoff)
    # all common characters of a text of m are at most m; no character of the first blocks folds to two
    short = math.ceil(len(folded) * cutoff / (200 - cutoff) - 1e-6)
    rows = groups.where((F.length("text") >= short) | ~F.col("text").rlike(r"^[\x00-\u00BB\u00BF-\u0131]*$"))
    if need:
        plain = F.lower(F.regexp_replace("text", r"\s+", " "))
        has = F.aggregate(F.array(*map(F.lit, pairs)), F.lit(0), lambda n, p: n + F.contains(plain, p).cast("int"))
        rows = rows.where((has >= need) | ~F.col("text").rlike(r"^\p{ASCII}*$"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, p, g, t in zip(b["doc_key"], b["page"], b["group_no"], b["text"]):
                f, at = fold(t or "")
                score, s, e = partial_similarity(folded, f.lower(), cutoff)
                if score >= cutoff:
                    out.append((d, p, g, round(score, 4), at[s], at[min(e, len(at) - 1)]))
            yield pd.DataFrame(out, columns=["doc_key", "page", "group_no", "score", "start", "end"])

    return rows.select("doc_key", "page", "group_no", "text").mapInPandas(run, "doc_key string, page int, group_no int, score double, start int, end int")


def phrase_pattern(phrases: list[str]) -> str:
    """One pattern for a phrase table (F7): longest first, an optional plural s, whole words."""
    body = "|".join(re.escape(p).replace(r"\ ", r"\s+") for p in sorted(phrases, key=lambda p: (-len(p), p)))
    return rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{body})s?(?![\p{{L}}\p{{N}}])"


def has_phrase(text: Column, phrases: list[str]) -> Column:
    return text.rlike(phrase_pattern(phrases))
