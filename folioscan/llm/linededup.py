"""Cross-site boilerplate lines, by distinct-site spread.

Every line that is not blank is known by a 128-bit key.  A HyperLogLog sketch of the
sites a line occurs on is built for each key by plain aggregation (sketches merge, so
a line that half the corpus repeats is combined before the shuffle).  Estimates well
below the threshold are dropped, those well above are boilerplate, and lines near the
threshold get an exact count of distinct sites.  A boilerplate line stays in its first
document (least id, then least text key, then line order) and goes from every other.

Everything is built from DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.storage import materialize

LG_K = 12
#: Relative half-width of the band around the threshold that is counted exactly:
#: six standard errors of a sketch with 2**LG_K registers.
BAND = 6 * 1.04 / (2 ** (LG_K / 2))


def _key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a string."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    text = F.col(text_col)
    doc = F.struct(F.col(id_col).alias("id"), *(k.alias(f"k{i}") for i, k in enumerate(_key(text))))
    rows = docs.where(text.isNotNull()).select(
        doc.alias("doc"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.posexplode(F.split(text, "\n")).alias("at", "line")
    )
    rows = rows.withColumn("line", F.trim("line")).where("line <> ''")
    h1, h2 = _key(F.col("line"))
    return rows.select("doc", "site", "at", h1.alias("h1"), h2.alias("h2"))


def boilerplate_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """``(h1, h2, first)`` of the lines on at least ``min_sites`` distinct sites."""
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("est"), F.count("*").alias("n"), F.min(F.struct("doc", "at")).alias("first")
    )
    wide = spread.where(F.col("n") >= min_sites)
    low, high = min_sites * (1 - BAND) - 1, min_sites * (1 + BAND) + 1
    sure = wide.where(F.col("est") > high).select("h1", "h2", "first")
    near = wide.where(F.col("est").between(low, high)).select("h1", "h2", "first")
    sites = lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct()
    exact = sites.groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("h1", "h2")
    return sure.unionByName(near.join(exact, ["h1", "h2"]))


def line_dedup(
    docs: DataFrame,
    min_sites: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
) -> DataFrame:
    """``docs`` with boilerplate lines cut from the text, and a column ``n_removed``.

    Lines end at U+000A and are compared without surrounding spaces; blank lines always
    stay.  A null site is a site of its own.  A null text stays null, an empty one
    empty.  Rows equal in id and text are treated alike, null ids too.  All columns pass
    through, but one that is named ``n_removed`` already gives way to the operator's.
    """
    docs = docs.drop("n_removed")
    lines = _lines(docs, id_col, text_col, site_col)
    plates = materialize(boilerplate_lines(lines, min_sites), "lines")
    hits = lines.join(plates, ["h1", "h2"]).where(F.col("first") != F.struct("doc", "at"))
    gone = hits.groupBy(F.col("doc").alias("__doc")).agg(F.collect_set("at").alias("__gone"))
    text = F.col(text_col)
    doc = F.struct(F.col(id_col).alias("id"), *(k.alias(f"k{i}") for i, k in enumerate(_key(text))))
    rows = docs.withColumn("__key", doc)
    rows = rows.join(gone, F.col("__key") == F.col("__doc"), "left")
    rows = rows.withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
    rows = rows.withColumn("n_removed", F.greatest("n_removed", F.lit(0).cast("long")))
    cut = F.when(F.col("n_removed") > 0, _without(F.split(text, "\n"), F.col("__gone"))).otherwise(text)
    return rows.withColumn(text_col, cut).drop("__gone", "__doc", "__key")


def _without(lines: Column, gone: Column) -> Column:
    """The text of the lines but those at the places ``gone``, in linear time."""

    def rest(ls: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone)
        return F.array_join(F.transform(places, lambda i: F.get(ls, i)), "\n")

    # bound once, however often the lines are named
    return F.element_at(F.transform(F.array(lines), rest), 1)


def oracle_sql(min_sites: int = 8) -> str:
    """DuckDB SQL for ``(doc_id, text, n_removed)`` of the documents table with distinct ids."""
    return f"""
WITH cut AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS raw,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
lines AS (SELECT *, trim(raw) AS line FROM cut),
plates AS (
  SELECT line, min(struct_pack(d := doc_id, a := pos)) AS first FROM lines WHERE line <> ''
  GROUP BY line HAVING count(DISTINCT site) >= {min_sites}),
marked AS (
  SELECT l.*, p.line IS NOT NULL AND (p.first.d, p.first.a) <> (l.doc_id, l.pos) AS gone
  FROM lines l LEFT JOIN plates p ON l.line = p.line),
docs AS (
  SELECT doc_id, string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept, count(*) FILTER (gone) AS n
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN n > 0 THEN coalesce(kept, '') ELSE d.text END AS text, coalesce(n, 0) AS n_removed
FROM documents d LEFT JOIN docs USING (doc_id)
"""
