"""Queries of sources and streams (on static frames; tests run them as streams)."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan import derive
from folioscan.registry import query
from folioscan.sources import html, layout_json
from folioscan.streaming import events as E


def _events(spark, sf_dir):
    return derive.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def t_tumbling_windows(spark, sf_dir):
    return E.tumbling(_events(spark, sf_dir)).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) t(k) GROUP BY ALL")
def t_sliding_windows(spark, sf_dir):
    return E.sliding(_events(spark, sf_dir)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM i GROUP BY user_id, k"""
)
def t_sessions(spark, sf_dir):
    s = E.sessions(_events(spark, sf_dir))
    return s.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def t_first_seen(spark, sf_dir):
    return E.first_seen(_events(spark, sf_dir).select("user_id", "event_type"), ["user_id", "event_type"])


@query("SELECT page_id, len(regexp_extract_all(html, '<[a-zA-Z]')) AS n_tags, len(regexp_extract_all(html, '(?i)<img')) AS n_images, len(regexp_extract_all(html, '(?i)<a\\s')) AS n_links, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)) AS title FROM pages")
def s12_html_facts(spark, sf_dir):
    return html.page_facts(derive.table(spark, sf_dir, "pages"))


@query(
    r"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr|/title)\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g') AS x FROM pages),
e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS x FROM t),
l AS (SELECT page_id, unnest(string_split(x, chr(10))) AS raw, generate_subscripts(string_split(x, chr(10)), 1) - 1 AS ord FROM e)
SELECT page_id, ord::INT AS ord, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS text FROM l WHERE trim(regexp_replace(raw, '\s+', ' ', 'g')) <> ''"""
)
def s3_html_text_lines(spark, sf_dir):
    return html.text_lines(derive.table(spark, sf_dir, "pages"))


def _layout(spark, sf_dir):
    d = derive.table(spark, sf_dir, "documents")
    line = lambda t, y: F.struct(t.alias("content"), F.array(*[v.cast("double") if hasattr(v, "cast") else F.lit(float(v)) for v in (1, y, 4, y, 4, y + 0.25, 1, y + 0.25)]).alias("polygon"))
    words = F.array(F.struct(F.lit("a").alias("content"), (F.col("doc_id") % 10 / 10).alias("confidence"), F.array(F.lit(1.0)).alias("polygon")), F.struct(F.lit("b").alias("content"), F.lit(0.99).alias("confidence"), F.array(F.lit(1.0)).alias("polygon")))
    page = F.struct(F.lit(1).alias("page_number"), F.lit(8.5).alias("width"), F.lit(11.0).alias("height"), F.lit("inch").alias("unit"), F.array(line(F.col("source"), 1.0), line(F.col("lang"), 2.0)).alias("lines"), words.alias("words"))
    cell = lambda r, c, t: F.struct(F.lit(r).alias("row_index"), F.lit(c).alias("column_index"), t.alias("content"))
    table = F.struct(F.lit(2).alias("row_count"), F.lit(2).alias("column_count"), F.array(cell(0, 0, F.lit("key")), cell(0, 1, F.lit("value")), cell(1, 1, F.col("source"))).alias("cells"), F.array(F.struct(F.lit(1).alias("page_number"), F.array(F.lit(1.0)).alias("polygon"))).alias("bounding_regions"))
    return d.select("doc_id", F.to_json(F.struct(F.struct(F.array(page).alias("pages"), F.array(table).alias("tables")).alias("analyze_result"))).alias("value"))


@query("SELECT doc_id, 0 AS page, k AS ord, CASE k WHEN 0 THEN source ELSE lang END AS text, 72.0::DOUBLE AS x0, 72.0::DOUBLE * (k + 1) AS y0, 288.0::DOUBLE AS x1, 72.0::DOUBLE * (k + 1) + 18 AS y1, 'layout' AS source FROM documents, (VALUES (0), (1)) t(k)")
def s5_layout_lines(spark, sf_dir):
    return layout_json.text_lines(_layout(spark, sf_dir), "doc_id")


@query("SELECT doc_id, 0 AS page, 2 AS n_words, CASE WHEN doc_id % 10 < 8 THEN 1 ELSE 0 END AS n_low FROM documents")
def s5_low_confidence(spark, sf_dir):
    return layout_json.low_confidence(_layout(spark, sf_dir), "doc_id")


@query("SELECT doc_id, 0 AS page, 0 AS table_no, [['key', 'value'], [NULL, source]] AS rows, 2 AS n_cols, 1 AS n_empty FROM documents")
def s10_layout_tables(spark, sf_dir):
    return layout_json.tables(_layout(spark, sf_dir), "doc_id")
