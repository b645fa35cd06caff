"""Queries of sheet sets, schedules, roles and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan import derive
from folioscan.plans import roles as R
from folioscan.plans import sheets as S
from folioscan.queries.pages import SUMMARY, summaries
from folioscan.registry import query

#: Sheets of a set: parts as pages, brands as set, a number from the key; every 23rd sheet is not read.
_SHEETS = """sheet AS (SELECT p_brand AS doc_key, p_partkey::INT AS page, CASE WHEN p_partkey % 23 <> 0 THEN 'A-' || (p_partkey % 400) END AS number, p_size FROM part)"""
_CALLS = "callout AS (SELECT p_brand AS doc_key, p_partkey::INT AS page, (p_size % 9)::VARCHAR AS view, 'A-' || ((p_partkey * 7) % 450) AS sheet FROM part)"
_VIEWS = "views AS (SELECT p_brand AS doc_key, p_partkey::INT AS page, unnest([(p_size % 5)::VARCHAR, (p_size % 7)::VARCHAR]) AS view FROM part)"
_LONE = "lone AS (SELECT p_brand AS doc_key, p_partkey::INT AS page, (p_size % 6)::VARCHAR AS mark FROM part)"


def index(spark, sf_dir):
    k = F.col("p_partkey")
    return derive.table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_key"), k.cast("int").alias("page"), F.when(k % 23 != 0, F.concat(F.lit("A-"), (k % 400).cast("string"))).alias("number"), "p_size")


def callouts(spark, sf_dir):
    k = F.col("p_partkey")
    return derive.table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_key"), k.cast("int").alias("page"), (F.col("p_size") % 9).cast("string").alias("view"), F.concat(F.lit("A-"), ((k * 7) % 450).cast("string")).alias("sheet"))


def views(spark, sf_dir):
    s = F.col("p_size")
    return derive.table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_key"), F.col("p_partkey").cast("int").alias("page"), F.explode(F.array((s % 5).cast("string"), (s % 7).cast("string"))).alias("view"))


def lone(spark, sf_dir):
    return derive.table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_key"), F.col("p_partkey").cast("int").alias("page"), (F.col("p_size") % 6).cast("string").alias("mark"))


@query(f"WITH {_SHEETS} SELECT doc_key, number, count(DISTINCT page) AS n_pages FROM sheet WHERE number IS NOT NULL GROUP BY ALL HAVING count(DISTINCT page) > 1")
def a20_duplicate_numbers(spark, sf_dir):
    return S.duplicate_numbers(index(spark, sf_dir))


@query(
    f"""WITH {_SHEETS}, {_CALLS}, {_VIEWS}, {_LONE},
t AS (SELECT doc_key, number AS sheet, count(DISTINCT page) AS n_target, min(page) AS target FROM sheet WHERE number IS NOT NULL GROUP BY ALL),
dup AS (SELECT doc_key, count(*) AS n_dup FROM (SELECT doc_key, number FROM sheet WHERE number IS NOT NULL GROUP BY ALL HAVING count(DISTINCT page) > 1) GROUP BY 1),
un AS (SELECT doc_key, page FROM sheet WHERE number IS NULL), unn AS (SELECT doc_key, count(*) AS n_unread FROM un GROUP BY 1),
v AS (SELECT doc_key, page AS target, list(view) AS views FROM views GROUP BY ALL), l AS (SELECT doc_key, page AS target, list(mark) AS lone FROM lone GROUP BY ALL)
SELECT c.doc_key, c.page, c.view, c.sheet, target, CASE WHEN target IS NULL AND n_dup > 0 THEN 'cannot_tell' WHEN target IS NULL AND n_unread > 0 THEN 'cannot_tell' WHEN target IS NULL THEN 'not_in_document'
 WHEN n_target > 1 THEN 'cannot_tell' WHEN views IS NULL THEN 'cannot_tell' WHEN list_contains(views, c.view) THEN 'resolved' WHEN list_contains(lone, c.view) THEN 'cannot_tell' ELSE 'unresolved' END AS status
FROM callout c LEFT JOIN t USING (doc_key, sheet) LEFT JOIN dup USING (doc_key) LEFT JOIN unn USING (doc_key) LEFT JOIN v USING (doc_key, target) LEFT JOIN l USING (doc_key, target)"""
)
def j17_x14_cross_references(spark, sf_dir):
    i = index(spark, sf_dir)
    return S.judge(callouts(spark, sf_dir), i, views(spark, sf_dir), i.where("number is null").select("doc_key", "page"), lone(spark, sf_dir)).drop("why")


@query(f"WITH {_SHEETS}, {_CALLS}, {_VIEWS}, {_LONE} SELECT DISTINCT * FROM (SELECT doc_key, page, mark FROM lone EXCEPT SELECT doc_key, page, view FROM views)")
def u4_unread_marks(spark, sf_dir):
    return S.unread_marks(lone(spark, sf_dir), views(spark, sf_dir))


_ROWS = "r AS (SELECT DISTINCT 'b' || (o_custkey % 10) AS doc_key, 'W-' || (o_orderkey % 300) AS mark FROM orders)"
_MARKS = "m AS (SELECT DISTINCT 'b' || (l_suppkey % 10) AS doc_key, CASE WHEN l_partkey % 9 = 0 THEN 'EF' ELSE 'W' END || '-' || (l_orderkey % 320) AS mark FROM lineitem)"


@query(
    f"""WITH {_ROWS}, {_MARKS}, un AS (SELECT * FROM (VALUES ('b1', 1), ('b4', 1)) t(doc_key, n_unread)),
b AS (SELECT coalesce(r.doc_key, m.doc_key) AS doc_key, coalesce(r.mark, m.mark) AS mark, r.mark IS NOT NULL AS row, m.mark IS NOT NULL AS seen FROM r FULL JOIN m ON r.doc_key = m.doc_key AND r.mark = m.mark),
f AS (SELECT *, regexp_extract(mark, '^([^0-9]*)', 1) || regexp_replace(regexp_extract(mark, '([0-9].*)$', 1), '[0-9]', '9', 'g') AS form FROM b),
g AS (SELECT doc_key, form, count(*) FILTER (row) AS n_rows, count(*) FILTER (NOT row) AS n_unlisted FROM f GROUP BY ALL)
SELECT doc_key, mark, CASE WHEN row THEN 'schedule' ELSE 'mark' END AS side, CASE WHEN row AND seen THEN 'listed' WHEN NOT seen AND n_unread > 0 THEN 'may_be_on_unread_sheet' WHEN NOT seen THEN 'no_mark'
 WHEN n_rows = 0 THEN 'cannot_tell' WHEN n_unlisted > n_rows THEN 'cannot_tell' ELSE 'no_row' END AS status FROM f JOIN g USING (doc_key, form) LEFT JOIN un USING (doc_key)"""
)
def j19_x15_schedule_marks(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = derive.table(spark, sf_dir, "orders").select(F.concat(F.lit("b"), (F.col("o_custkey") % 10).cast("string")).alias("doc_key"), F.lit("s").alias("schedule"), F.concat(F.lit("W-"), (k % 300).cast("string")).alias("mark"))
    l = derive.table(spark, sf_dir, "lineitem")
    marks = l.select(F.concat(F.lit("b"), (F.col("l_suppkey") % 10).cast("string")).alias("doc_key"), F.lit(0).alias("page"), F.concat(F.when(F.col("l_partkey") % 9 == 0, "EF").otherwise("W"), F.lit("-"), (F.col("l_orderkey") % 320).cast("string")).alias("mark"))
    return S.schedule_check(rows, marks, spark.createDataFrame([("b1", 3), ("b4", 5)], "doc_key string, page int"))


_PIECES = """piece AS (SELECT p_brand AS doc_key, p_partkey::INT AS page, 'A-' || p_partkey AS token, 0.95::DOUBLE AS rx, 0.955::DOUBLE AS ry, 30.0::DOUBLE AS size, p_partkey % 2 = 0 AS labelled FROM part WHERE p_partkey % 4 <> 3
 UNION ALL SELECT p_brand, p_partkey::INT, 'B-' || (p_partkey % 3), 0.5::DOUBLE, 0.5::DOUBLE, 10.0::DOUBLE, p_partkey % 10 = 3 FROM part)"""


@query(
    f"""WITH {_PIECES}, n AS (SELECT doc_key, count(DISTINCT page) AS n FROM piece GROUP BY 1), c AS (SELECT doc_key, count(*)::DOUBLE / any_value(n.n) AS cover FROM piece JOIN n USING (doc_key) WHERE size = 30 GROUP BY doc_key)
SELECT p_brand AS doc_key, p_partkey::INT AS page, CASE WHEN p_partkey % 4 <> 3 AND cover >= 0.5 THEN 'A-' || p_partkey WHEN p_partkey % 10 = 3 THEN 'B-' || (p_partkey % 3) END AS number,
 CASE WHEN p_partkey % 4 <> 3 AND cover >= 0.5 THEN 'slot' WHEN p_partkey % 10 = 3 THEN 'label' END AS how,
 round(CASE WHEN p_partkey % 4 <> 3 AND cover >= 0.5 THEN least(0.98, 0.6 + 0.4 * cover) WHEN p_partkey % 10 = 3 THEN 0.75 END, 9)::DOUBLE AS confidence FROM part LEFT JOIN c ON c.doc_key = p_brand"""
)
def f19_a15_sheet_index(spark, sf_dir):
    p, k = derive.table(spark, sf_dir, "part"), F.col("p_partkey")
    base = [F.col("p_brand").alias("doc_key"), k.cast("int").alias("page")]
    a = p.where(k % 4 != 3).select(*base, F.concat(F.lit("A-"), k.cast("string")).alias("token"), F.lit(0.95).alias("rx"), F.lit(0.955).alias("ry"), F.lit(30.0).alias("size"), (k % 2 == 0).alias("labelled"))
    b = p.select(*base, F.concat(F.lit("B-"), (k % 3).cast("string")).alias("token"), F.lit(0.5).alias("rx"), F.lit(0.5).alias("ry"), F.lit(10.0).alias("size"), (k % 10 == 3).alias("labelled"))
    sheets = p.select(*base, F.lit(None).cast("string").alias("label"), F.lit(8.0).alias("median_size"))
    return S.sheet_index(sheets, a.unionByName(b)).withColumn("confidence", F.round("confidence", 9))


@query(
    """WITH t AS (SELECT 'd' || (doc_id // 50) AS doc_key, (doc_id % 50)::INT AS page, doc_id AS table_id, CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 3 END AS n_cols, (72 + doc_id % 2 * 5)::DOUBLE AS x0, 500.0::DOUBLE AS x1, doc_id % 4 AS h, doc_id % 5 = 0 AS cont FROM documents)
SELECT b.doc_key, b.page, b.table_id, a.table_id AS continues FROM t a JOIN t b ON a.doc_key = b.doc_key AND b.page = a.page + 1 AND a.n_cols = b.n_cols AND abs(a.x0 - b.x0) <= 6 WHERE a.h = b.h OR b.cont"""
)
def j22_continued_tables(spark, sf_dir):
    i = F.col("doc_id")
    t = derive.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.floor(i / 50).cast("string")).alias("doc_key"), (i % 50).cast("int").alias("page"), i.alias("table_id"), F.when(i % 3 == 0, 4).otherwise(3).alias("n_cols"), (72 + i % 2 * 5).cast("double").alias("x0"), F.lit(100.0).alias("y0"), F.lit(500.0).alias("x1"), F.array((i % 4).cast("string")).alias("header"), F.lit(612.0).alias("width"), (i % 5 == 0).alias("says_continued"))
    return S.continued_tables(t)


_ROLE_PAGES = SUMMARY + r""",
rp AS (SELECT *, CASE page % 12 WHEN 3 THEN 'LOG OF BORING B-2' WHEN 4 THEN 'untitled' WHEN 6 THEN 'Sieve analysis' WHEN 8 THEN 'Site plan' ELSE heading END AS title,
 CASE page % 12 WHEN 10 THEN 'Dear Sir, yours truly' ELSE '' END AS body, (page * 7) % 8 AS log_fields FROM summary),
cued AS (SELECT *, CASE WHEN regexp_matches(lower(title), 'log of boring') THEN 'boring_log' WHEN regexp_matches(lower(title), 'sieve analysis') THEN 'lab_test' WHEN regexp_matches(lower(title), 'site plan') THEN 'plan' WHEN body <> '' THEN 'letter' END AS cue,
 page % 12 IN (3, 6, 8) AS decisive FROM rp),
roles AS (SELECT *, CASE WHEN kind = 'blank' THEN 'blank' WHEN divider_title IS NOT NULL THEN 'divider' WHEN page = 0 AND n_words <= 120 THEN 'cover' WHEN decisive THEN cue WHEN cue IS NOT NULL THEN cue
 WHEN kind IN ('drawing_sheet', 'figure') THEN 'figure' WHEN kind = 'text' THEN 'narrative' ELSE 'other' END AS role FROM cued)"""


def role_pages(spark, sf_dir):
    p, m = summaries(spark, sf_dir), F.col("page") % 12
    title = F.when(m == 3, "LOG OF BORING B-2").when(m == 4, "untitled").when(m == 6, "Sieve analysis").when(m == 8, "Site plan").otherwise(F.col("heading"))
    p = p.withColumn("title", title).withColumn("body", F.when(m == 10, "Dear Sir, yours truly").otherwise("")).withColumn("log_fields", (F.col("page") * 7) % 8)
    cued = R.cue_roles(p).withColumn("appended", F.lit(False)).withColumn("tab_role", F.lit(None).cast("string"))
    return R.assign(cued)


@query(_ROLE_PAGES + " SELECT doc_key, page, role FROM roles")
def p23_w6_page_roles(spark, sf_dir):
    return role_pages(spark, sf_dir).select("doc_key", "page", "role")


@query(
    _ROLE_PAGES
    + """, e AS (SELECT *, role IN ('other', 'figure') AND (log_fields >= 5 OR (printed_of IS NOT NULL AND log_fields >= 3)) AS loose FROM roles),
g AS (SELECT *, sum(CASE WHEN loose THEN 0 ELSE 1 END) OVER (PARTITION BY doc_key ORDER BY page) AS isl FROM e)
SELECT doc_key, page, CASE WHEN loose AND first_value(role) OVER w = 'boring_log' THEN 'boring_log' ELSE role END AS smoothed FROM g WINDOW w AS (PARTITION BY doc_key, isl ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def w3_smoothed_roles(spark, sf_dir):
    return R.smooth(role_pages(spark, sf_dir)).select("doc_key", "page", "smoothed")


@query(
    _ROLE_PAGES
    + """, k AS (SELECT *, CASE role WHEN 'boring_log' THEN 'log' WHEN 'lab_test' THEN 'test' WHEN 'letter' THEN 'letter' WHEN 'plan' THEN 'drawing' END AS k FROM roles),
s AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR k IS DISTINCT FROM lag(k) OVER w OR coalesce(printed_page = 1 AND printed_of IS NOT NULL, false) THEN 1 ELSE 0 END AS st FROM k WINDOW w AS (PARTITION BY doc_key ORDER BY page)),
i AS (SELECT *, sum(st) OVER (PARTITION BY doc_key ORDER BY page) AS isl FROM s)
SELECT doc_key, any_value(k) AS kind, min(page) AS first_page, max(page) AS last_page FROM i WHERE k IS NOT NULL GROUP BY doc_key, isl"""
)
def w2_work_items(spark, sf_dir):
    return R.items(role_pages(spark, sf_dir).withColumn("item_key", F.lit(None).cast("string"))).drop("key")


@query()
def w5_sections(spark, sf_dir):
    d = summaries(spark, sf_dir).where("divider_title is not null")
    return R.sections(d.select("doc_key", "page", F.col("divider_title").alias("title"), F.lit(50).alias("n_pages")))


@query(_ROLE_PAGES + " SELECT doc_key, page, rtrim(lpad(page::VARCHAR, 4, ' ') || ' ' || rpad(kind, 13, ' ') || ' ' || rpad(role[1:12], 12, ' ') || ' ' || coalesce(heading[1:100], '')) AS line FROM roles")
def k10_page_ledger(spark, sf_dir):
    return R.ledger(role_pages(spark, sf_dir))


@query("SELECT p_brand AS doc_key, p_partkey::INT AS ord, (p_size % 9 + 1) || '.' || (p_partkey % 5) AS number, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE 'iv' END AS printed_page FROM part")
def f25_outline_entries(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    text = F.concat((s % 9 + 1).cast("string"), F.lit("."), (k % 5).cast("string"), F.lit(" "), F.col("p_name"), F.lit(" ........ "), F.when(k % 2 == 0, s.cast("string")).otherwise("iv"))
    lines = derive.table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_key"), F.lit(2).alias("page"), k.cast("int").alias("ord"), text.alias("text"))
    return R.outline_lines(lines).drop("page")
