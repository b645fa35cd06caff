"""Mixing sources to target weights by Pareto order sampling.

Every source gets a share of the mix in proportion to its weight, but no more than
``most`` times its own size; what a source cannot take is shared among the others by
weight (the limits are found in one ordered pass).  Within a source each document is
expected ``target / size`` times: the whole part of that is certain copies, the rest is
an inclusion probability p.  Documents are ranked by the Pareto statistic, the odds of a
random number over the odds of p, and are taken in that order until the sampled words
come nearest to what the certain copies leave of the target.

The random number comes from a digest of the id and the seed, so reruns and lost
executors give the same mix.  No source is ever sorted as a whole: words are summed
for each of ``CELLS`` cells of the rank, running sums find the cell in which a source's
sample ends, that cell is cut in ``CELLS`` again, and only the documents of the cell in
which the sample ends there, one in 67 million of a source, are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.storage import materialize

CELLS = 8192
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    r"""Runs of characters other than space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source.

    Sources are weighed in code-point order, null last; ``weights`` repeat.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    rows = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long"))
    rows = rows.withColumn("cap", F.lit(most) * F.col("source_size"))
    every = Window.partitionBy()
    by_need = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("all", F.lit(share) * F.sum("source_size").over(every))
    rows = rows.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward))
    # the first source, by need, that its share does not fill sets the level for the rest
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))).over(every)
    target = F.least("cap", F.coalesce(level["level"] * F.col("w"), F.col("cap")))
    return rows.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    share: float = 1.5,
    most: float = 2.0,
    weights: tuple[int, ...] = WEIGHTS,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    size_col: str | None = None,
) -> DataFrame:
    """``docs`` with ``size, source_size, target, taken`` (long, long, double, long).

    ``taken`` is ``size`` times the copies the mix takes of a document.  A null source
    is a source of its own; a null text has size 0 and takes nothing; rows equal in id
    and text are drawn alike but taken one by one.  ``size_col`` names a column that holds
    the sizes already.  All columns pass through, but those that bear one of the four
    names already give way to the operator's.
    """
    size = (F.col(size_col).cast("long") if size_col else word_count(F.col(text_col))).alias("__size")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    uniform = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(2.0**48)
    # a key that no source's name can equal another's, the null one's included
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))
    added = [size, uniform.alias("__u"), key.alias("__s"), F.xxhash64(text_col).alias("__t")]
    # texts are read once for all sums
    slim = materialize(docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("__id"), *added), "mix")
    totals = slim.groupBy("source").agg(F.sum("__size").alias("source_size"))
    plan = source_targets(totals, share, most, weights).select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("__s"), F.col("source_size").alias("__total"), F.col("target").alias("__target"),
        F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).alias("__whole"),
    )
    plan = plan.withColumn("__left", F.col("__target") - F.col("__whole") * F.col("__total"))
    plan = plan.withColumn("__p", F.when(F.col("__total") > 0, F.col("__left") / F.col("__total")).otherwise(0.0))
    plan = materialize(plan, "mix")
    # the Pareto statistic q of probability p; z = q / (1 + q) is in (0, 1) and has its order
    odds = F.when(F.col("__p") > 0, (F.col("__u") / (1 - F.col("__u"))) / (F.col("__p") / (1 - F.col("__p"))))
    cell = F.least(F.floor(F.col("__q") / (1 + F.col("__q")) * CELLS**2), F.lit(CELLS**2 - 1))

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.join(plan, "__s").withColumn("__q", odds).withColumn("__cell", cell)

    wide = ranked(slim).where("__p > 0")
    coarse = wide.groupBy("__s", F.floor(F.col("__cell") / CELLS).alias("c"), "__left").agg(F.sum("__size").alias("words"))
    ends = _end(coarse, F.lit(0))
    ends = materialize(ends.withColumnsRenamed({"c": "__coarse", "upto": "__before"}), "mix")
    inside = wide.join(ends, "__s").where(F.floor(F.col("__cell") / CELLS) == F.col("__coarse"))
    fine = inside.groupBy("__s", F.col("__cell").alias("c"), "__left", "__before").agg(F.sum("__size").alias("words"))
    ends = materialize(_end(fine, F.col("__before")).withColumnsRenamed({"c": "__end", "upto": "__upto"}), "mix")
    names = ("size", "source_size", "target", "taken")
    kept = [F.col(c) for c in docs.columns if c not in names]
    placed = ranked(docs.select(*kept, F.col(id_col).alias("__id"), *added)).join(ends, "__s", "left")
    order = Window.partitionBy("__s").orderBy("__q", "__id", "__size", "__t")
    edge = placed.where(F.col("__cell") == F.col("__end"))
    edge = edge.withColumn("__b", F.col("__upto") + F.coalesce(F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edge = edge.withColumn("__in", F.col("__b") + F.col("__size") / 2 <= F.col("__left")).drop("__b")
    rest = placed.where(~F.col("__cell").eqNullSafe(F.col("__end")) | F.col("__end").isNull())
    rest = rest.withColumn("__in", F.coalesce(F.col("__cell") < F.col("__end"), F.lit(False)))
    taken = (F.col("__size") * (F.col("__whole") + F.when(F.col("__in"), 1).otherwise(0))).cast("long")
    shown = [F.col("__size").alias("size"), F.col("__total").alias("source_size"), F.col("__target").alias("target"), taken.alias("taken")]
    return edge.unionByName(rest).select(*kept, *shown)


def _end(cells: DataFrame, before: Column) -> DataFrame:
    """``(__s, c, upto)``: the last cell of each source that begins below what is left of its target."""
    run = Window.partitionBy("__s").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("upto", before + F.coalesce(F.sum("words").over(run), F.lit(0)))
    last = cells.where(F.col("upto") < F.col("__left")).groupBy("__s").agg(F.max(F.struct("c", "upto")).alias("e"))
    return last.select("__s", "e.c", "e.upto")


def repeated(mixed: DataFrame) -> DataFrame:
    """The rows of `mix` as often as the mix takes them, without its four columns."""
    copies = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    times = F.explode(F.when(copies > 0, F.array_repeat(F.lit(0), copies)).otherwise(F.array().cast("array<int>")))
    return mixed.withColumn("__copy", times).drop("__copy", "size", "source_size", "target", "taken")


def oracle_sql(share: float = 1.5, most: float = 2.0, seed: int = 7) -> str:
    """DuckDB SQL for the digest columns over the documents table (weights 5, 2, 1)."""
    return f"""
WITH base AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w, {most}::DOUBLE * source_size AS cap,
         {share}::DOUBLE * sum(source_size) OVER () AS total FROM totals),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT arg_min(level, (cap / w, level)) FROM levels WHERE level * w <= cap) * w, cap)) AS target FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets),
spread AS (
  SELECT *, target - whole * source_size AS remainder,
         CASE WHEN source_size > 0 THEN (target - whole * source_size) / source_size ELSE 0 END AS p FROM plan),
ranked AS (
  SELECT b.*, s.source_size, s.target, s.whole, s.remainder, s.p,
         CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q
  FROM base b JOIN spread s ON b.source IS NOT DISTINCT FROM s.source),
run AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM ranked)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN p > 0 AND upto < remainder AND upto + size / 2 <= remainder THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""
