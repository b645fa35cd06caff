"""Web pages as text lines, without a parser: block tags end lines, other tags go, entities are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def text_of(html: Column) -> Column:
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr|/title)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for a, b in _ENTITIES:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def text_lines(pages: DataFrame, key: str = "page_id", html_col: str = "html") -> DataFrame:
    """``key, ord, text`` of the lines that are not blank."""
    rows = pages.select(key, F.posexplode(F.split(text_of(F.col(html_col)), "\n")).alias("ord", "raw"))
    return rows.select(key, "ord", F.trim(F.regexp_replace("raw", r"\s+", " ")).alias("text")).where("text <> ''")


def page_facts(pages: DataFrame, key: str = "page_id", html_col: str = "html") -> DataFrame:
    """``key, n_tags, n_images, n_links, title``."""
    h = F.col(html_col)
    title = F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title", 1)
    return pages.select(key, F.regexp_count(h, F.lit("<[a-zA-Z]")).alias("n_tags"), F.regexp_count(h, F.lit("(?i)<img")).alias("n_images"), F.regexp_count(h, F.lit("(?i)<a\\s")).alias("n_links"), F.trim(title).alias("title"))
