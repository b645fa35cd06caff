"""Queries of text rules: search, numbers, units, sheet numbers, labels, dates, marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan import derive
from folioscan.functions import quantities as Q
from folioscan.functions import search as S
from folioscan.functions import text as T
from folioscan.functions import units as U
from folioscan.registry import query

LINE = derive.with_sql("page", "line")


def groups(spark, sf_dir):
    return derive.lines(spark, sf_dir).select("doc_key", "page", F.col("ord").alias("group_no"), "text")


@query(LINE + " SELECT doc_key, page, ord, strpos(lower(text), 'tion the') - 1 AS start, substr(text, greatest(strpos(lower(text), 'tion the') - 60, 1), 8 + 120 - greatest(61 - strpos(lower(text), 'tion the'), 0)) AS snippet FROM line WHERE contains(lower(text), 'tion the')")
def f1_contains_literal(spark, sf_dir):
    return S.contains_literal(derive.lines(spark, sf_dir), "tion the")


@query(LINE + ", h AS (SELECT doc_key, page, ord AS group_no, unnest(regexp_extract_all(text, '(?i)[a-z]+tion')) AS matched FROM line WHERE length(text) = strlen(text)) SELECT doc_key, page, group_no, matched, count(*) AS n FROM h GROUP BY ALL")
def f1_regex_search(spark, sf_dir):
    # ascii text only, so that folding leaves the words as they are
    hits = S.search(groups(spark, sf_dir).where(F.length("text") == F.octet_length("text")), "[a-z]+tion", regex=True)
    return hits.groupBy("doc_key", "page", "group_no", "matched").agg(F.count("*").alias("n"))


@query()
def f2_f3_folded_search(spark, sf_dir):
    return S.search(groups(spark, sf_dir), "creer")


@query()
def f4_fuzzy_search(spark, sf_dir):
    wanted = derive.table(spark, sf_dir, "benchmark").orderBy("item_id").first()["text"]
    return S.first_hits(S.fuzzy(groups(spark, sf_dir), wanted, 85.0), [F.desc("score"), "doc_key", "page", "group_no"], 50)


@query("SELECT doc_id, regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}])(the\\s+and|of|and)s?($|[^\\p{L}\\p{N}])') AS hit FROM documents")
def f7_phrases(spark, sf_dir):
    return derive.table(spark, sf_dir, "documents").select("doc_id", S.has_phrase(F.col("text"), ["of", "and", "the and"]).alias("hit"))


@query("SELECT doc_id, list_transform(regexp_extract_all(text, '[-+]?[0-9]+(?:\\.[0-9]+)?'), lambda x: x::DOUBLE) AS numbers FROM documents WHERE regexp_matches(text, '[0-9]')")
def f9_numbers(spark, sf_dir):
    return derive.table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]")).select("doc_id", T.numbers_in(F.col("text")).alias("numbers"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size / 8::DOUBLE WHEN 2 THEN p_size + 1 / 4::DOUBLE END::DOUBLE AS value FROM part")
def f13_parse_number(spark, sf_dir):
    p, s = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(p % 4 == 0, s).when(p % 4 == 1, F.concat(s, F.lit("/8"))).when(p % 4 == 2, F.concat(s, F.lit(" 1 / 4"))).otherwise(F.concat(s, F.lit(" ft")))
    return derive.table(spark, sf_dir, "part").select("p_partkey", U.parse_number(text).alias("value"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.125 WHEN 2 THEN 1.5 END::DOUBLE AS page_len, CASE WHEN p_partkey % 4 < 3 THEN 'in' END AS page_unit,
 CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size + 6 / 12::DOUBLE WHEN 2 THEN p_size END::DOUBLE AS real_len, CASE WHEN p_partkey % 4 < 3 THEN 'ft' END AS real_unit,
 CASE p_partkey % 4 WHEN 0 THEN p_size * 0.3048::DOUBLE / 0.0254::DOUBLE / 1 WHEN 1 THEN (p_size + 6 / 12::DOUBLE) * 0.3048::DOUBLE / 0.0254::DOUBLE / 0.125::DOUBLE
   WHEN 2 THEN p_size * 0.3048::DOUBLE / 0.0254::DOUBLE / 1.5::DOUBLE END AS magnification FROM part"""
)
def f14_parse_ratio(spark, sf_dir):
    p, s = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(p % 4 == 0, F.concat(F.lit("SCALE: 1 in = "), s, F.lit(" ft"))).when(p % 4 == 1, F.concat(F.lit('1/8" = '), s, F.lit("'-6\""))).when(p % 4 == 2, F.concat(F.lit('1-1/2" = '), s, F.lit("'"))).otherwise(F.concat(F.lit("as noted "), s))
    got = derive.table(spark, sf_dir, "part").select("p_partkey", U.parse_ratio(text).alias("r"))
    return got.select("p_partkey", "r.page_len", "r.page_unit", "r.real_len", "r.real_unit", U.magnification(F.col("r")).alias("magnification"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size * 0.3048::DOUBLE / 1.0::DOUBLE WHEN 1 THEN p_size::DOUBLE END AS metres FROM part")
def g3_f12_convert(spark, sf_dir):
    p = F.col("p_partkey")
    unit = F.when(p % 3 == 0, "Feet").when(p % 3 == 1, "metres").otherwise("pt")
    return derive.table(spark, sf_dir, "part").select("p_partkey", U.convert_length(F.col("p_size").cast("double"), unit, F.lit("m")).alias("metres"))


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity * 2::DOUBLE AS value, 'ft' AS units, greatest(0, least(1, least(1 - l_discount, 0.95::DOUBLE))) AS confidence,
 sqrt(CASE WHEN l_tax > 0 THEN l_tax * l_tax ELSE 0 END + 0.05::DOUBLE * 0.05::DOUBLE) AS rel_uncertainty FROM lineitem"""
)
def g1_g2_scaled_quantity(spark, sf_dir):
    q = U.quantity(F.col("l_quantity"), F.lit("pt"), 1 - F.col("l_discount"), F.col("l_tax"))
    rows = derive.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", U.scaled(q, F.lit(2.0), F.lit("ft"), F.lit(0.95), F.lit(0.05)).alias("q"))
    return rows.select("l_orderkey", "l_linenumber", "q.value", "q.units", "q.confidence", "q.rel_uncertainty")


_BRAND = "CASE p_partkey % 3 WHEN 0 THEN 'a-' || p_size || '01' WHEN 1 THEN 'FP ' || p_size WHEN 2 THEN (p_size || '.0' || (p_partkey % 7)) END"


@query(
    f"""WITH n AS (SELECT p_partkey, upper(regexp_replace({_BRAND}, '\\s+', '', 'g')) AS number FROM part)
SELECT p_partkey, number, coalesce(nullif(regexp_extract(number, '^([A-Z]+)', 1), ''), split_part(number, '.', 1)) AS discipline,
 regexp_replace(regexp_replace(number, '[0-9]', '9', 'g'), '[A-Z]', 'A', 'g') AS shape, regexp_matches(number, '^(?:{T.LETTERED}|{T.DECIMAL})$') AS is_number FROM n"""
)
def f16_sheet_numbers(spark, sf_dir):
    p, s = F.col("p_partkey"), F.col("p_size").cast("string")
    raw = F.when(p % 3 == 0, F.concat(F.lit("a-"), s, F.lit("01"))).when(p % 3 == 1, F.concat(F.lit("FP "), s)).otherwise(F.concat(s, F.lit(".0"), (p % 7).cast("string")))
    n = T.normal_number(raw)
    return derive.table(spark, sf_dir, "part").select("p_partkey", n.alias("number"), T.discipline(raw).alias("discipline"), T.number_shape(raw).alias("shape"), T.is_sheet_number(n).alias("is_number"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'A-' || p_size WHEN 1 THEN 'S-' || p_size END AS number FROM part")
def f17_labelled_numbers(spark, sf_dir):
    p, s = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(p % 3 == 0, F.concat(F.lit("Sheet No. A-"), s)).when(p % 3 == 1, F.concat(F.lit("DWG # S-"), s, F.lit(" rev 2"))).otherwise(F.concat(F.lit("see sheet A-"), s))
    return derive.table(spark, sf_dir, "part").select("p_partkey", T.labelled_number(text).alias("number"))


@query("SELECT p_partkey, '3' AS view, 'A-' || p_size AS sheet FROM part UNION ALL SELECT p_partkey, 'B', 'S-1' FROM part")
def f20_inline_callouts(spark, sf_dir):
    text = F.concat(F.lit("SEE 3/A-"), F.col("p_size").cast("string"), F.lit(" AND B/S-1, W/ S-201"))
    return derive.table(spark, sf_dir, "part").select("p_partkey", F.inline(T.callouts(text)))


@query(
    """SELECT s_suppkey, ['boundary_Clay', 'boundary_Sand', 'gwt', 'surface', 'boundary_Silt', NULL, 'boundary_Fill'][(s_suppkey % 7 + 1)::INT] AS role FROM supplier"""
)
def f21_label_roles(spark, sf_dir):
    texts = F.array(*map(F.lit, ("sandy CLAY", "silty Sand, dense", "Piezometric level", "Existing grade", "(ML) sandy", "concrete", "rock fill")))
    return derive.table(spark, sf_dir, "supplier").select("s_suppkey", T.label_role(F.element_at(texts, (F.col("s_suppkey") % 7 + 1).cast("int"))).alias("role"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, 'T%H:%M:%S') || '-04:00' ELSE '' END AS iso FROM orders")
def f22_pdf_dates(spark, sf_dir):
    d = F.col("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("D:"), F.date_format(d, "yyyyMMddHHmmss"), F.lit("-04'00'"))).otherwise(F.concat(F.lit("D:"), F.date_format(d, "yyyyMMdd")))
    return derive.table(spark, sf_dir, "orders").select("o_orderkey", T.pdf_date(raw).alias("iso"))


@query(
    derive.with_sql("markup")
    + """ SELECT xref, 'p' || page || '.' || CASE WHEN xref % 3 = 0 THEN 'nNM' || xref ELSE 'h' || substr(sha1(kind || '|' || x0::BIGINT || ',' || y0::BIGINT || ',' || x1::BIGINT || ',' || y1::BIGINT || '||' || author || '|' || text), 1, 10) END AS uid FROM markup"""
)
def f23_stable_ids(spark, sf_dir):
    m = derive.markups(spark, sf_dir)
    name = F.when(F.col("xref") % 3 == 0, F.concat(F.lit("NM"), F.col("xref").cast("string")))
    return m.select("xref", T.stable_id(F.col("page"), name, F.col("kind"), [F.col(c) for c in ("x0", "y0", "x1", "y1")], F.lit(None).cast("string"), F.col("author"), F.col("text")).alias("uid"))


@query("SELECT s_suppkey, unnest(list_transform(range(s_suppkey % 20 + 1, s_suppkey % 20 + 4), lambda n: 'W-' || lpad(n::VARCHAR, 2, '0'))) AS mark FROM supplier")
def u7_expand_ranges(spark, sf_dir):
    n = F.col("s_suppkey") % 20 + 1
    a, b = (F.concat(F.lit("W-"), F.lpad((n + k).cast("string"), 2, "0")) for k in (0, 2))
    return derive.table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(T.expand_range(a, b)).alias("mark"))


@query("SELECT s_suppkey, s_suppkey % 30 BETWEEN 5 AND 12 AS held FROM supplier")
def u7_range_holds(spark, sf_dir):
    mark = F.concat(F.lit("FCU-"), (F.col("s_suppkey") % 30).cast("string"))
    return derive.table(spark, sf_dir, "supplier").select("s_suppkey", T.range_holds(mark, F.lit("FCU-5"), F.lit("FCU-12")).alias("held"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'FCU-' || repeat('9', length((s_suppkey)::VARCHAR)) WHEN 1 THEN repeat('9', length((s_suppkey + 100)::VARCHAR)) || 'A' WHEN 2 THEN 'W' || repeat('9', length(s_suppkey::VARCHAR)) || '-AA' END AS form FROM supplier")
def p22_mark_forms(spark, sf_dir):
    s = F.col("s_suppkey")
    mark = F.when(s % 4 == 0, F.concat(F.lit("FCU-"), s.cast("string"))).when(s % 4 == 1, F.concat((s + 100).cast("string"), F.lit("B"))).when(s % 4 == 2, F.concat(F.lit("W"), s.cast("string"), F.lit("-XY"))).otherwise(F.lit("AB"))
    return derive.table(spark, sf_dir, "supplier").select("s_suppkey", T.mark_shape(mark).alias("form"))


@query("SELECT l_orderkey, l_linenumber, l_quantity AS value, 'ft' AS units, 'length' AS kind, 'approximately' AS qualifier FROM lineitem")
def f10_stated_quantities(spark, sf_dir):
    rows = derive.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("Set the wall about "), F.format_string("%.1f", "l_quantity"), F.lit(" ft from the line.")).alias("text"))
    return Q.mentions(rows, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "value", "units", "kind", "qualifier")


@query("SELECT p_partkey, p_size::DOUBLE AS value, 'psf' AS units FROM part")
def f11_p12_quantities_by_unit(spark, sf_dir):
    s = F.col("p_size").cast("string")
    rows = derive.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Load ("), F.lit("psf): "), s, F.lit(" at EL. "), s, F.lit(" and "), s, F.lit(" m")).alias("text"))
    return Q.mentions(rows, ["p_partkey"], units=["PSF."]).select("p_partkey", "value", "units")


@query(
    LINE
    + r""", keys AS (SELECT doc_key, page, ord, trim(regexp_replace(array_to_string(list_transform(list_filter(list_transform(string_split(text, '|'), lambda p: trim(p)), lambda p: length(regexp_replace(p, '[^\p{L}]', '', 'g')) >= 3), lambda p: lower(regexp_replace(p, '[0-9]', '#', 'g'))), ' | '), '\s+', ' ', 'g')) AS key FROM line)
SELECT key, count(*) AS n FROM keys GROUP BY key HAVING count(*) > 1"""
)
def f6_running_keys(spark, sf_dir):
    k = derive.lines(spark, sf_dir).select(T.running_key(F.col("text")).alias("key"))
    return k.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


@query(
    """WITH r AS (SELECT n_regionkey, list([n_nationkey::VARCHAR, n_name] ORDER BY n_nationkey) AS rows FROM nation GROUP BY 1)
SELECT n_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || array_to_string(list_transform(rows, lambda x: '| ' || x[1] || ' | ' || x[2] || ' |'), chr(10)) AS md FROM r"""
)
def k9_table_markdown(spark, sf_dir):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: F.array(s["n_nationkey"].cast("string"), s["n_name"]))
    g = derive.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(rows.alias("rows"))
    return g.select("n_regionkey", T.table_markdown(F.array(F.lit("key"), F.lit("name")), F.col("rows")).alias("md"))


@query(
    """SELECT b.item_id, count(*) AS n_docs, min(d.doc_id) AS first_doc FROM benchmark b JOIN documents d
ON contains(regexp_replace(lower(d.text), '\\s+', ' ', 'g'), regexp_replace(lower(b.text), '\\s+', ' ', 'g')) GROUP BY b.item_id"""
)
def f1_passages_in_documents(spark, sf_dir):
    """Which documents hold a benchmark passage: shingles of its first words are the join key, not a cross join."""
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    b = derive.table(spark, sf_dir, "benchmark").select("item_id", fold(F.col("text")).alias("passage"))
    words = F.split("passage", " ")
    # inner words are whole in any text that holds the passage
    b = b.withColumn("key", F.when(F.size(words) >= 6, F.xxhash64(F.array_join(F.slice(words, 2, 4), " "))))
    d = derive.table(spark, sf_dir, "documents").select("doc_id", fold(F.col("text")).alias("body"))
    # the words are a column of their own: inside the lambda they would be split for every shingle
    d = d.withColumn("w", F.split("body", " "))
    w = F.col("w")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 3, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, 4), " ")))
    long = d.select("doc_id", "body", F.explode(F.array_distinct(grams)).alias("key")).join(b.where("key is not null"), "key").where(F.contains("body", F.col("passage")))
    return long.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))
