"""What a sheet's title block says, schedules in parts, and the context of a found mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import units as U
from folioscan.operators.spatial_joins import boxes_meeting

# What a block prints where a sheet has no one scale.
NO_SCALE = r"(?i)^(?:as\s+(?:noted|shown|indicated)|varies|none|no\s+scale|n/a|n\.?\s?t\.?\s?s\.?|not\s+to\s+scale)$"
_CONTINUED = r"(?i)[\s,(-]*\b(?:continued|cont'?d?)\b\.?\)?\s*$"


def cell_values(lines: DataFrame, label: str, static: DataFrame | None = None, below: float = 1.5) -> DataFrame:
    """``doc_key, page, value``: what stands beside or under a label in the block.

    The rest of the label's own line, else the nearest line starting within ``below`` of
    its height under it; texts that the whole set repeats are no values.
    """
    own = F.trim(F.regexp_replace("text", label, ""))
    l = lines.withColumn("__hit", F.col("text").rlike(label)).withColumn("__own", F.when(F.col("__hit"), own))
    heads = l.where("__hit").select("doc_key", "page", F.col("ord").alias("label_ord"), "__own", F.col("x0").alias("lx0"), F.col("y1").alias("ly0"), F.col("x1").alias("lx1"), (F.col("y1") + below * (F.col("y1") - F.col("y0"))).alias("ly1"))
    under = l.where(~F.col("__hit"))
    if static is not None:
        under = under.join(static.select("doc_key", "text"), ["doc_key", "text"], "left_anti")
    under = under.select("doc_key", "page", "text", F.col("x0").alias("rx0"), F.col("y0").alias("ry0"), F.col("x1").alias("rx1"), F.col("y1").alias("ry1"))
    near = boxes_meeting(heads, under, 100.0, ["doc_key", "page"]).groupBy("doc_key", "page", "label_ord").agg(F.min(F.struct("ry0", "rx0", "text")).alias("n"))
    got = heads.join(near, ["doc_key", "page", "label_ord"], "left").withColumn("value", F.coalesce(F.nullif(F.col("__own"), F.lit("")), F.col("n.text")))
    return got.where("value is not null").groupBy("doc_key", "page").agg(F.min_by("value", "label_ord").alias("value"))


def sheet_scales(values: DataFrame) -> DataFrame:
    """Scale cells read: ``doc_key, page, value, magnification, stated``; words for "no one scale" are kept apart from unread ones."""
    r = values.withColumn("__r", U.parse_ratio(F.col("value")))
    stated = F.when(F.col("value").rlike(NO_SCALE), "no one scale").when(F.col("__r").isNotNull(), "ratio").otherwise("unread")
    return r.select("doc_key", "page", "value", U.magnification(F.col("__r")).alias("magnification"), stated.alias("stated"))


def latest_revisions(rows: DataFrame) -> DataFrame:
    """``doc_key, page, revision``: the highest mark of a revision block; letters come after numbers, longer numbers later."""
    mark = F.regexp_extract(F.upper("text"), r"^\(?([A-Z]|[0-9]{1,2})\)?\s+[0-9]{1,4}[-/.][0-9]{1,2}", 1)
    m = rows.withColumn("m", mark).where("m <> ''")
    order = F.struct(F.col("m").rlike("[A-Z]").alias("letter"), F.lpad("m", 2, "0").alias("p"))
    return m.groupBy("doc_key", "page").agg(F.max_by("m", order).alias("revision"))


def joined_schedules(parts: DataFrame) -> DataFrame:
    """``doc_key, schedule, n_parts, columns`` of the parts with one title, CONTINUED aside."""
    title = F.upper(F.trim(F.regexp_replace(F.regexp_replace("title", _CONTINUED, ""), r"\s+", " ")))
    g = parts.withColumn("schedule", title).groupBy("doc_key", "schedule")
    return g.agg(F.count("*").alias("n_parts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("columns")))).alias("columns"))


def hit_context(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """``hits`` with ``context`` (J30): a rule close above and close below makes a table row, else plan.

    ``rules``: horizontal ``(doc_key, page, rx0, ry, rx1)``; close is half the hit's height.
    """
    h = hits.withColumn("__h", (F.col("y1") - F.col("y0")) / 2)
    reach = h.select("doc_key", "page", "hit_id", F.col("x0").alias("lx0"), (F.col("y0") - F.col("__h")).alias("ly0"), F.col("x1").alias("lx1"), (F.col("y1") + F.col("__h")).alias("ly1"), F.col("y0").alias("top"), F.col("y1").alias("foot"))
    r = rules.select("doc_key", "page", "rx0", F.col("ry").alias("ry0"), "rx1", F.col("ry").alias("ry1"))
    met = boxes_meeting(reach, r, 100.0, ["doc_key", "page"]).groupBy("doc_key", "page", "hit_id").agg(F.max((F.col("ry0") <= F.col("top")).cast("int")).alias("above"), F.max((F.col("ry0") >= F.col("foot")).cast("int")).alias("below"))
    out = hits.join(met, ["doc_key", "page", "hit_id"], "left")
    return out.withColumn("context", F.when((F.col("above") == 1) & (F.col("below") == 1), "table_row").otherwise("plan")).drop("above", "below")


def log_decades(lines: DataFrame, keys: list[str], position: str, tol: float = 0.035) -> DataFrame:
    """Gridlines whose gaps follow a decade (W10): ``keys, start, phase, matched``.

    Ratios of neighbouring gaps are compared with those of log10(k + 1) - log10(k); three
    in a row with consecutive k name the decade's phase.
    """
    by = Window.partitionBy(*keys).orderBy(position)
    g = lines.withColumn("gap", F.lead(position).over(by) - F.col(position))
    g = g.withColumn("ratio", F.try_divide(F.lead("gap").over(by), "gap")).where("ratio is not null")
    step = lambda k: F.log10((k + 1) / k)
    ks = F.sequence(F.lit(1), F.lit(9))
    want = lambda k: F.when(k < 9, step(k + 1) / step(k)).otherwise(step(F.lit(1.0)) / step(F.lit(9.0)))
    g = g.withColumn("k", F.explode(F.filter(ks, lambda k: F.abs(F.col("ratio") / want(k.cast("double")) - 1) <= tol)))
    place = lines.select(*keys, position, F.row_number().over(by).alias("n"))
    g = g.join(place, [*keys, position])
    # consecutive lines with consecutive k keep n - k modulo nine
    g = g.withColumn("phase", F.pmod(F.col("n") - F.col("k"), F.lit(9)))
    per = g.groupBy(*keys, "phase").agg(F.min(position).alias("start"), F.count_distinct("n").alias("matched")).where("matched >= 3")
    # neighbouring steps are alike late in a decade, so several phases match some lines
    best = F.max_by(F.struct("phase", "start", "matched"), F.struct("matched", (-F.col("phase")).alias("p")))
    return per.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")
