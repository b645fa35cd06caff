"""Queries of the page map over the derived binders."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan import derive
from folioscan.functions import text as T
from folioscan.plans import pagemap as P
from folioscan.registry import query

_WORDS = r"CASE WHEN trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace({0}, '\s+', ' ', 'g')), ' ')) END"
_DIVIDER = "|".join(T.DIVIDER_WORDS)
_WHOLE = ", ".join(f"'{t}'" for t in T.DIVIDER_TITLES)
STATS = derive.with_sql("page", "line") + rf""",
banded AS (
  SELECT *, y1 <= {T.BAND}::DOUBLE * height AS top, y1 > {T.BAND}::DOUBLE * height AND y0 >= (1 - {T.BAND}::DOUBLE) * height AS bottom,
         {_WORDS.format("text")} AS nw FROM line JOIN (SELECT doc_key, page, height FROM page) USING (doc_key, page)),
stats AS (
  SELECT doc_key, page, sum(length(text))::BIGINT AS n_chars, sum(nw)::BIGINT AS n_words,
         sum(CASE WHEN top OR bottom THEN 0 ELSE nw END)::BIGINT AS body_words, count(*) AS n_lines,
         sum(length(text) - length(replace(text, chr(65533), '')))::BIGINT AS n_unmapped,
         string_agg(text, ' | ' ORDER BY round_even(y0 / 4, 0), ord) FILTER (top) AS header,
         string_agg(text, ' | ' ORDER BY round_even(y0 / 4, 0), ord) FILTER (bottom) AS footer,
         arg_max(text, (size, -ord)) AS heading, list(text ORDER BY ord) AS texts FROM banded GROUP BY doc_key, page)"""
_KEY = r"trim(regexp_replace(array_to_string(list_transform(list_filter(list_transform(string_split(coalesce({0}, ''), '|'), lambda p: trim(p)), lambda p: length(regexp_replace(p, '[^\p{{L}}]', '', 'g')) >= 3), lambda p: lower(regexp_replace(p, '[0-9]', '#', 'g'))), ' | '), '\s+', ' ', 'g'))"
SUMMARY = STATS + rf""",
filled AS (
  SELECT p.doc_key, p.page, width, height, width / 72 * (height / 72) AS area, n_vector_paths, image_coverage, ruling_h, ruling_v, n_cad_chars, optical,
         coalesce(n_chars, 0) AS n_chars, coalesce(n_words, 0) AS n_words, coalesce(body_words, 0) AS body_words, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_unmapped, 0) AS n_unmapped, header, footer, heading, coalesce(texts, []) AS texts,
         coalesce(header, '') || ' ' || coalesce(footer, '') AS bands
  FROM page p LEFT JOIN stats s USING (doc_key, page)),
ruled AS (
  SELECT *, image_coverage >= 0.5 AND CASE WHEN optical THEN n_vector_paths < 50 ELSE n_chars + n_cad_chars < 50 END AS image_only,
         CASE WHEN n_chars > 0 THEN n_unmapped / n_chars > 0.1 ELSE false END AS unreliable FROM filled),
kinds AS (
  SELECT *, CASE WHEN n_chars + n_cad_chars < 5 AND n_vector_paths < 5 AND image_coverage < 0.02 THEN 'blank'
    WHEN area >= 250 AND (n_vector_paths >= 200 OR image_coverage >= 0.5 OR n_cad_chars > 0) THEN 'drawing_sheet'
    WHEN image_only THEN 'scanned' WHEN ruling_h >= 12 AND ruling_v >= 12 THEN 'form'
    WHEN n_chars + n_cad_chars < 1500 AND (n_vector_paths >= 300 OR image_coverage >= 0.35) THEN 'figure'
    WHEN n_chars + n_cad_chars >= 600 AND n_vector_paths < 300 AND image_coverage < 0.35 THEN 'text' ELSE 'mixed' END AS kind FROM ruled),
summary AS (
  SELECT *, (image_only AND NOT optical) OR unreliable AS needs_ocr, NOT unreliable AS text_reliable,
    CASE WHEN regexp_matches(bands, '(?i)\bpage\s+([0-9]{{1,4}})\s+of\s+([0-9]{{1,4}})\b') THEN regexp_extract(bands, '(?i)\bpage\s+([0-9]{{1,4}})\s+of\s+([0-9]{{1,4}})\b', 1)
         WHEN regexp_matches(bands, '(?i)\bpage\s+([0-9]{{1,4}})\b') THEN regexp_extract(bands, '(?i)\bpage\s+([0-9]{{1,4}})\b', 1) END::INT AS printed_page,
    CASE WHEN regexp_matches(bands, '(?i)\bpage\s+([0-9]{{1,4}})\s+of\s+([0-9]{{1,4}})\b') THEN regexp_extract(bands, '(?i)\bpage\s+([0-9]{{1,4}})\s+of\s+([0-9]{{1,4}})\b', 2) END::INT AS printed_of,
    CASE WHEN n_words <= 60 AND len(list_filter(list_transform(CASE WHEN heading IS NULL THEN [] ELSE [heading] END || texts[1:3], lambda t: trim(regexp_replace(t, '\s+', ' ', 'g'))),
           lambda t: trim(lower(t), ' :.-') IN ({_WHOLE}) OR regexp_matches(t, '(?i)^(?:{_DIVIDER})\b'))) > 0
         THEN trim(regexp_replace(heading, '\s+', ' ', 'g'))[1:100] END AS divider_title,
    substr(sha1(kind || n_vector_paths::VARCHAR || array_to_string(list_transform(texts, lambda t: t || chr(10)), '')), 1, 16) AS content_key
  FROM kinds)"""
_SAME = "({0} <> '' AND {1} <> '' AND ({0} = {1} OR (least(length({0}), length({1})) >= 12 AND contains(CASE WHEN length({0}) <= length({1}) THEN {1} ELSE {0} END, CASE WHEN length({0}) <= length({1}) THEN {0} ELSE {1} END))))"
SEGMENT = SUMMARY + f""",
keyed AS (
  SELECT *, {_KEY.format("header")} AS hk, {_KEY.format("footer")} AS fk,
         CASE WHEN area >= 250 THEN 2 WHEN area >= 150 THEN 1 ELSE 0 END AS cls, kind = 'drawing_sheet' AS sheet FROM summary),
was AS (
  SELECT *, lag(hk) OVER w AS phk, lag(fk) OVER w AS pfk, lag(cls) OVER w AS pcls, lag(sheet) OVER w AS psheet, lag(printed_page) OVER w AS ppage
  FROM keyed WINDOW w AS (PARTITION BY doc_key ORDER BY page)),
broken AS (
  SELECT *, CASE WHEN pcls IS NULL THEN 1 WHEN divider_title IS NOT NULL THEN 1 WHEN cls <> pcls THEN 1 WHEN sheet <> psheet THEN 1 WHEN sheet THEN 0
    WHEN printed_page = 1 AND ppage <> 1 AND NOT ({_SAME.format("hk", "phk")} OR {_SAME.format("fk", "pfk")}) THEN 1
    WHEN (hk <> '' OR fk <> '') AND NOT ({_SAME.format("hk", "phk")} OR {_SAME.format("fk", "pfk")}) THEN 1
    WHEN hk = '' AND fk = '' AND (phk <> '' OR pfk <> '') AND kind <> 'blank' THEN 1 ELSE 0 END AS new FROM was),
segmented AS (SELECT *, (sum(new) OVER (PARTITION BY doc_key ORDER BY page) - 1)::INT AS segment FROM broken)"""


def summaries(spark, sf_dir):
    return P.page_summaries(derive.lines(spark, sf_dir), derive.pages(spark, sf_dir))


@query(STATS + " SELECT doc_key, page, n_chars, n_words, body_words, n_lines, n_unmapped, header, footer, heading FROM stats")
def a3_text_statistics(spark, sf_dir):
    return P.text_statistics(derive.lines(spark, sf_dir), derive.pages(spark, sf_dir)).drop("texts")


@query(SUMMARY + " SELECT doc_key, page, kind, area, needs_ocr, text_reliable, n_chars, n_words, body_words, header, heading[1:120] AS heading, printed_page, printed_of, divider_title, content_key FROM summary")
def p9_page_map(spark, sf_dir):
    return summaries(spark, sf_dir).select("doc_key", "page", "kind", "area", "needs_ocr", "text_reliable", "n_chars", "n_words", "body_words", "header", "heading", "printed_page", "printed_of", "divider_title", "content_key")


@query(SUMMARY + " SELECT doc_key, page, kind FROM summary WHERE kind IN ('text', 'drawing_sheet')")
def p10_page_map_kinds(spark, sf_dir):
    return summaries(spark, sf_dir).where(F.col("kind").isin("text", "drawing_sheet")).select("doc_key", "page", "kind")


@query(SEGMENT + " SELECT doc_key, page, segment, hk, fk FROM segmented")
def w1_segmentation(spark, sf_dir):
    return P.with_segments(summaries(spark, sf_dir)).select("doc_key", "page", "segment", "hk", "fk")


@query(
    SEGMENT
    + r""",
base AS (
  SELECT doc_key, segment, min(page) AS first_page, max(page) AS last_page, count(*) AS n_pages, min(printed_page) AS printed_from, max(printed_page) AS printed_to,
         arg_min(divider_title, page) AS divider, arg_min(heading[1:120], page) AS head, bool_and(kind = 'drawing_sheet') AS all_sheets FROM segmented GROUP BY ALL),
kc AS (SELECT doc_key, segment, kind, count(*) AS n, min(page) AS f FROM segmented GROUP BY ALL),
km AS (SELECT doc_key, segment, arg_max(kind, (n, -f)) AS main_kind FROM kc GROUP BY ALL),
hc AS (SELECT doc_key, segment, hk, count(*) AS n, min(page) AS f FROM segmented WHERE header IS NOT NULL GROUP BY ALL),
hm AS (SELECT doc_key, segment, arg_max(hk, (n, -f)) AS hk FROM hc GROUP BY ALL),
hh AS (SELECT doc_key, segment, arg_min(header, page) AS header FROM segmented JOIN hm USING (doc_key, segment, hk) GROUP BY ALL),
bare AS (SELECT *, trim(regexp_replace(header, '(?i)\bpage\s+[0-9]{1,4}(?:\s+of\s+[0-9]{1,4})?\b', '', 'g'), ' |') AS title_text FROM hh)
SELECT doc_key, segment, first_page, last_page, n_pages, coalesce(divider, CASE WHEN all_sheets THEN 'Drawing sheets' END, nullif(title_text, ''), head, main_kind)[1:100] AS title,
       main_kind, header, printed_from, printed_to
FROM base JOIN km USING (doc_key, segment) LEFT JOIN bare USING (doc_key, segment)"""
)
def a9_segments(spark, sf_dir):
    return P.segment_summaries(P.with_segments(summaries(spark, sf_dir)))


@query(
    SUMMARY
    + """,
firsts AS (SELECT doc_key, page, min(page) OVER (PARTITION BY doc_key, content_key, width, height) AS duplicate_of FROM summary WHERE body_words >= 15 AND kind <> 'blank')
SELECT * FROM firsts WHERE duplicate_of < page"""
)
def x11_duplicates(spark, sf_dir):
    return P.duplicates(summaries(spark, sf_dir))


@query(
    derive.with_sql("page", "line")
    + """,
sized AS (SELECT doc_key, page, y1 - y0 AS h, sum(length(text)) AS w FROM line WHERE y1 - y0 >= 2 GROUP BY ALL),
run AS (SELECT *, sum(w) OVER (PARTITION BY doc_key, page ORDER BY h) AS run, sum(w) OVER (PARTITION BY doc_key, page) AS every FROM sized)
SELECT doc_key, page, CASE WHEN max(every) >= 40 THEN min(h) FILTER (run >= 0.25 * every) END AS text_size FROM run GROUP BY ALL"""
)
def a8_text_size(spark, sf_dir):
    return P.text_size(derive.lines(spark, sf_dir))


@query(
    STATS
    + r""",
masked AS (
  SELECT DISTINCT doc_key, page, lower(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[0-9]', '#', 'g')) AS masked FROM banded WHERE top OR bottom)
SELECT doc_key, masked, count(*) AS n_pages FROM masked WHERE length(masked) >= 4 GROUP BY ALL HAVING count(*) >= 3"""
)
def w4_boilerplate(spark, sf_dir):
    return P.boilerplate(derive.lines(spark, sf_dir), derive.pages(spark, sf_dir))


@query(
    SUMMARY
    + """,
said AS (
  SELECT doc_key, page, unnest(list_filter([
    CASE WHEN kind = 'scanned' AND needs_ocr THEN 'no text layer: view it or attach OCR' END,
    CASE WHEN kind = 'scanned' AND NOT needs_ocr THEN 'text read optically: view it to confirm' END,
    CASE WHEN kind = 'drawing_sheet' THEN 'labels in drafting order: view the sheet' END,
    CASE WHEN kind = 'form' THEN 'cells in drafting order: view the page' END,
    CASE WHEN kind = 'figure' THEN 'labels of a figure: view the page' END,
    CASE WHEN kind = 'mixed' AND image_coverage >= 0.2 THEN 'images are not in the text: view them' END,
    CASE WHEN NOT text_reliable THEN 'text layer unreliable: do not quote it' END], lambda x: x IS NOT NULL)) AS advice FROM summary)
SELECT * FROM said"""
)
def p15_advice(spark, sf_dir):
    return P.advice(summaries(spark, sf_dir))


@query(SUMMARY + " SELECT doc_key, page, kind, NOT needs_ocr AS searchable FROM summary WHERE kind IN ('scanned', 'drawing_sheet', 'form', 'figure') OR NOT text_reliable OR needs_ocr")
def p16_to_view(spark, sf_dir):
    return P.to_view(summaries(spark, sf_dir))


@query(
    SUMMARY
    + """,
runs AS (SELECT doc_key, kind, page, page - row_number() OVER (PARTITION BY doc_key, kind ORDER BY page) AS g FROM summary),
ends AS (SELECT doc_key, kind, min(page) AS a, max(page) AS b FROM runs GROUP BY doc_key, kind, g)
SELECT doc_key, kind, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM ends GROUP BY ALL"""
)
def w15_a28_pages_by_kind(spark, sf_dir):
    return P.page_ranges(summaries(spark, sf_dir), ["doc_key", "kind"])


@query(SUMMARY + " SELECT doc_key, page, divider_title FROM summary WHERE divider_title IS NOT NULL")
def p13_dividers(spark, sf_dir):
    return summaries(spark, sf_dir).where("divider_title is not null").select("doc_key", "page", "divider_title")


@query(SUMMARY + " SELECT doc_key, page, printed_page, printed_of FROM summary WHERE printed_page IS NOT NULL")
def p14_printed_numbers(spark, sf_dir):
    return summaries(spark, sf_dir).where("printed_page is not null").select("doc_key", "page", "printed_page", "printed_of")




@query(
    derive.with_sql("page")
    + """,
h AS (SELECT doc_key, page, width, height, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT % 4096 AS hash FROM page)
SELECT a.doc_key, a.page, min((b.page, bit_count(xor(a.hash, b.hash))))[1] AS duplicate_of, min((b.page, bit_count(xor(a.hash, b.hash))))[2]::INT AS distance
FROM h a JOIN h b ON a.doc_key = b.doc_key AND a.width = b.width AND a.height = b.height AND b.page < a.page AND bit_count(xor(a.hash, b.hash)) <= 2
GROUP BY a.doc_key, a.page"""
)
def j21_image_duplicates(spark, sf_dir):
    digest = F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 15), 16, 10).cast("long")
    pages = derive.pages(spark, sf_dir).select("doc_key", "page", F.lit("scanned").alias("kind"), "width", "height", (digest % 4096).alias("hash"))
    return P.image_duplicates(pages)
