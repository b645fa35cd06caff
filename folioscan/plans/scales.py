"""Scales, rulers, logs and readings: stored and stated scales reconciled, labels anchored, layers and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import units as U
from folioscan.operators.spatial_joins import intervals

# Evidence ladder of scale sources, and their rank in reconciliation.
EVIDENCE = {"stored": 0.98, "bar": 0.95, "ruler": 0.90, "axis": 0.85, "stated": 0.70, "grid": 0.60}
RANK = {"stored": 0, "bar": 1, "stated": 2}
AGREE = 0.02


def value_at(s: Column, slope: Column, intercept: Column, transform: Column) -> Column:
    """A position read through a scale, linear or decadic."""
    v = intercept + slope * s
    return F.when(transform == "log10", F.pow(F.lit(10.0), v)).otherwise(v)


def position_of(v: Column, slope: Column, intercept: Column, transform: Column) -> Column:
    """The inverse of `value_at`; null where a decadic scale has no such value."""
    t = F.when(transform == "log10", F.when(v > 0, F.log10(v))).otherwise(v)
    return F.when(slope != 0, (t - intercept) / slope)


def confidence_of(source: Column) -> Column:
    """Confidence of a scale by its kind of evidence (G14); null for an unknown kind."""
    return F.create_map(*(F.lit(x) for kv in EVIDENCE.items() for x in kv))[source]


def reconciled(scales: DataFrame) -> DataFrame:
    """``scales`` with ``primary, gap, confidence, warning``.

    ``(doc_key, page, scale_id, source, per_point)``, per point in metres.  The primary is
    the first by rank; a stated scale within 2 % of it rises to .9, any other disagreement
    names both and warns.
    """
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv))[F.col("source")], F.lit(3))
    by = Window.partitionBy("doc_key", "page")
    s = scales.withColumn("__r", rank).withColumn("__p", F.min(F.struct("__r", "scale_id", "per_point")).over(by))
    gap = F.try_divide(F.abs(F.col("per_point") - F.col("__p.per_point")), F.col("__p.per_point"))
    s = s.withColumn("primary", F.col("scale_id") == F.col("__p.scale_id")).withColumn("gap", gap)
    others = F.min(F.when(~F.col("primary"), F.col("gap"))).over(by)
    agree = F.when(F.col("primary"), others <= AGREE).otherwise(F.col("gap") <= AGREE)
    conf = F.when((F.col("source") == "stated") & F.coalesce(agree, F.lit(False)), 0.9).otherwise(confidence_of(F.col("source")))
    warn = F.when(~F.col("primary") & (F.col("gap") > AGREE), F.concat(F.lit("differs from "), F.col("__p.scale_id")))
    return s.withColumn("confidence", conf).withColumn("warning", warn).drop("__r", "__p")


def scale_notes(lines: DataFrame) -> DataFrame:
    """Scale notes of text lines as proposals (F15): ``doc_key, page, ord, ratio, magnification, confidence``, never applied."""
    n = U.NUMBER
    pats = rf"(?i)({n}\s*(?:\"|in\.?|inch(?:es)?|mm|cm)\s*=\s*{n}\s*(?:'|ft\.?|feet|m)(?:\s*-?\s*{n}\s*\")?|\b1\s*:\s*[0-9]{{2,5}}\b)"
    found = F.nullif(F.regexp_extract("text", pats, 1), F.lit(""))
    said = F.col("text").rlike(r"(?i)\bscale\b")
    rows = lines.withColumn("ratio", found).where("ratio is not null").withColumn("__p", U.parse_ratio(F.col("ratio")))
    conf = F.when(said & F.contains("ratio", F.lit("=")), 0.85).when(said, 0.75).when(F.contains("ratio", F.lit("=")), 0.6).otherwise(0.45)
    return rows.where("__p is not null").select("doc_key", "page", "ord", "ratio", U.magnification(F.col("__p")).alias("magnification"), conf.alias("confidence"))


def viewport_factor(viewports: DataFrame) -> DataFrame:
    """``viewports`` with ``factor`` and ``unit`` only where the file is calibrated (G4): not the 1:1 default, not geographic."""
    usable = (F.col("kind") != "geo") & (F.col("x_per_point") > 0) & ~((F.col("ratio") == "1:1") & (F.col("x_unit") == "pt"))
    return viewports.withColumn("factor", F.when(usable, F.col("x_per_point"))).withColumn("unit", F.when(usable, U.normal_unit(F.col("x_unit"))))


def anchors(labels: DataFrame, ticks: DataFrame, reach: float = 12.0) -> DataFrame:
    """Label positions tied to what they name (J27): ``run_id, ord, position, plus_minus, anchored_by``.

    Ticks, if 60 % of a run's labels (two at least) have one and the offsets' median absolute
    deviation is small; else label centres with their height as uncertainty.  Medians are
    the element at half the count.
    """
    from folioscan.operators.spatial_joins import reached

    a = labels.withColumn("c", F.explode(reached(F.col("mid") - reach, F.col("mid") + reach, reach)))
    t = ticks.withColumn("c", F.floor(F.col("at") / reach).cast("long"))
    near = a.join(t, ["run_id", "c"]).where(F.abs(F.col("at") - F.col("mid")) <= reach)
    best = near.groupBy("run_id", "ord").agg(F.min_by("at", F.struct(F.abs(F.col("at") - F.col("mid")), F.col("at"))).alias("at"))
    l = labels.join(best, ["run_id", "ord"], "left").withColumn("off", F.col("at") - F.col("mid"))

    def middle(c: str) -> Column:
        ordered = F.array_sort(F.collect_list(c))
        return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))

    n = l.groupBy("run_id").agg(F.count("*").alias("n"), F.count("off").alias("n_tick"), middle("off").alias("med"), middle("height").alias("h"))
    l = l.join(n, "run_id").withColumn("dev", F.abs(F.col("off") - F.col("med")))
    mad = l.groupBy("run_id").agg(middle("dev").alias("mad"))
    l = l.join(mad, "run_id")
    ticked = (F.col("n_tick") >= F.greatest(F.lit(2.0), 0.6 * F.col("n"))) & (F.col("mad") <= F.greatest(F.lit(0.6), 0.25 * F.col("h")))
    ticked = F.coalesce(ticked, F.lit(False))
    position = F.when(ticked, F.coalesce(F.col("at"), F.col("mid") + F.col("med"))).otherwise(F.col("mid"))
    return l.select("run_id", "ord", position.alias("position"), F.when(ticked, F.greatest("mad", F.lit(0.5))).otherwise(0.75 * F.col("height") + 0.5).alias("plus_minus"), F.when(ticked, "tick").otherwise("label").alias("anchored_by"))


def ruler_candidates(columns: DataFrame) -> DataFrame:
    """The column that is a log's depth ruler (X17): ``doc_key, column, score``.

    A header that says depth +10, even steps +1.5, a tenth for every drawn tick; an
    elevation column only if its header says so.
    """
    named = F.col("header").rlike(r"(?i)\bdepth\b")
    elevation = F.col("header").rlike(r"(?i)\belev")
    score = F.when(named, 10.0).otherwise(0.0) + F.when(F.col("even"), 1.5).otherwise(0.0) + F.col("n_ticks") / 10
    ok = F.col("n_labels") >= 3
    c = columns.where(ok & (F.col("rising") | elevation)).withColumn("score", score)
    return c.groupBy("doc_key").agg(F.max_by(F.struct("column", "score"), F.struct("score", F.col("column"))).alias("b")).select("doc_key", "b.*")


def layers(boundaries: DataFrame, descriptions: DataFrame, merge: float = 2.5, size: float = 100.0) -> DataFrame:
    """``doc_key, top, bottom, confidence, description`` between boundaries.

    Boundaries nearer than ``merge`` to the one before are one; a description belongs to
    the last boundary at or above its top; a boundary without text at a page's top and
    trailing ones without text go; the last layer's bottom is null.
    """
    by = Window.partitionBy("doc_key").orderBy("y")
    b = boundaries.withColumn("prev", F.lag("y").over(by)).where(F.col("prev").isNull() | (F.col("y") - F.col("prev") > merge)).drop("prev")
    b = b.withColumn("next", F.lead("y").over(by))
    # the last boundary has no end, so its cells end where the descriptions do
    end = descriptions.groupBy("doc_key").agg((F.max("at") + 1).alias("end"))
    bands = b.join(end, "doc_key").select("doc_key", F.col("y").alias("top"), F.coalesce("next", F.greatest("end", F.col("y"))).alias("hi"))
    text = intervals(descriptions, bands, "at", "top", "hi", size, ["doc_key"])
    said = text.groupBy("doc_key", F.col("top").alias("y")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]), " ").alias("description"))
    out = b.join(said, ["doc_key", "y"], "left")
    last_text = F.max(F.when(F.col("description").isNotNull(), F.col("y"))).over(Window.partitionBy("doc_key"))
    out = out.withColumn("__last", last_text).where(F.col("y") <= F.col("__last"))
    conf = F.when(F.col("kind").isin("rule", "tick"), 0.85).when(F.col("kind") == "symbol", 0.7).otherwise(0.5)
    return out.select("doc_key", F.col("y").alias("top"), F.when(F.col("y") < F.col("__last"), F.col("next")).alias("bottom"), conf.alias("confidence"), "description")


def samples(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """Consecutive sample lines of a log as intervals with the label between them (W14): ``doc_key, top, bottom, label``."""
    by = Window.partitionBy("doc_key").orderBy("y")
    iv = lines.withColumn("bottom", F.lead("y").over(by)).where("bottom is not null").select("doc_key", F.col("y").alias("top"), "bottom")
    hit = intervals(labels, iv, "at", "top", "bottom", 100.0, ["doc_key"])
    return hit.groupBy("doc_key", "top", "bottom").agg(F.min_by("label", F.struct("at", "label")).alias("label"))


def cells(lines: DataFrame, columns: DataFrame, fits: DataFrame) -> DataFrame:
    """Lines of a log placed in columns, with the depth that the ruler reads (J26): ``doc_key, ord, column, depth``."""
    hit = intervals(lines, columns, "xc", "lo", "hi", 50.0, ["doc_key"])
    out = hit.join(fits, "doc_key", "left")
    return out.select("doc_key", "ord", "column", (F.col("intercept") + F.col("slope") * F.col("yc")).alias("depth"))


def value_beside(labels: DataFrame, values: DataFrame, right: float = 70.0, below: float = 6.0) -> DataFrame:
    """The nearest value right of a label or just below it (J28): ``doc_key, label_id, value_id``."""
    from folioscan.operators.spatial_joins import boxes_meeting

    reach = labels.select("doc_key", F.col("id").alias("label_id"), F.col("x0").alias("lx0"), F.col("y0").alias("ly0"), (F.col("x1") + right).alias("lx1"), (F.col("y1") + below).alias("ly1"), F.col("x1").alias("edge"), F.col("y1").alias("foot"))
    v = values.select("doc_key", F.col("id").alias("value_id"), *(F.col(c).alias("r" + c) for c in ("x0", "y0", "x1", "y1")))
    pairs = boxes_meeting(reach, v, 100.0, ["doc_key"]).where("label_id <> value_id")
    dx, dy = F.greatest(F.col("rx0") - F.col("edge"), F.lit(0.0)), F.greatest(F.col("ry0") - F.col("foot"), F.lit(0.0))
    ok = ((F.col("rx0") >= F.col("edge")) & (F.col("ry0") < F.col("foot"))) | (F.col("ry0") >= F.col("foot"))
    return pairs.where(ok).groupBy("doc_key", "label_id").agg(F.min_by("value_id", F.struct((dx + dy).alias("d"), F.col("value_id"))).alias("value_id"))


def read_line(lines: DataFrame, boxes: DataFrame, fits: DataFrame, pad: float = 6.0) -> DataFrame:
    """A drawn line read near a box (X23): ``doc_key, box_id, value, n_lines, status``.

    One line in reach gives its value; several give none and are ambiguous; none reads
    the box's centre with the pad as uncertainty, unsnapped.
    """
    b = boxes.withColumn("lo", F.col("y0") - pad).withColumn("hi", F.col("y1") + pad)
    hit = intervals(lines.select("doc_key", "y"), b.select("doc_key", "box_id", "lo", "hi"), "y", "lo", "hi", 100.0, ["doc_key"])
    n = hit.groupBy("doc_key", "box_id").agg(F.count("*").alias("n_lines"), F.min("y").alias("y"))
    out = b.join(n, ["doc_key", "box_id"], "left").join(fits, "doc_key", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))
    mid = (F.col("y0") + F.col("y1")) / 2
    at = F.when(F.col("n_lines") == 1, F.col("y")).when(F.col("n_lines") == 0, mid)
    status = F.when(F.col("n_lines") == 1, "read").when(F.col("n_lines") == 0, "unsnapped").otherwise("ambiguous")
    return out.select("doc_key", "box_id", (F.col("intercept") + F.col("slope") * at).alias("value"), F.when(F.col("n_lines") == 0, pad * F.abs(F.col("slope"))).alias("plus_minus"), "n_lines", status.alias("status"))


def display_value(value: Column, plus_minus: Column, resolution: Column) -> Column:
    """A value with its uncertainty, never finer than what is printed (F26); the uncertainty is rounded up to one figure, two after a 1."""
    exp = F.floor(F.log10(plus_minus))
    sig = F.when(plus_minus / F.pow(F.lit(10.0), exp) < 2, 2).otherwise(1)
    stated = plus_minus > 0
    dec_pm = F.when(stated, F.greatest(F.lit(0), -(exp - sig + 1))).otherwise(3).cast("int")
    dec_res = F.when(resolution > 0, F.greatest(F.lit(0), -F.floor(F.log10(resolution) + 1e-9))).cast("int")
    dec = F.least(dec_pm, F.coalesce(dec_res, dec_pm))
    unit = F.pow(F.lit(10.0), -dec_pm)
    up = F.ceil(plus_minus / unit - 1e-9) * unit

    def fixed(v: Column, d: Column) -> Column:
        out = F.format_string("%.0f", F.bround(v, 0))
        for k in range(1, 7):
            out = F.when(d == k, F.format_string(f"%.{k}f", F.bround(v, k))).otherwise(out)
        return out

    text = fixed(value, dec)
    return F.when(value.isNull(), None).when(stated, F.concat(text, F.lit(" +/- "), fixed(up, dec_pm))).otherwise(text)


def interpolated(profile: DataFrame, at: DataFrame, keys: list[str]) -> DataFrame:
    """``z`` of a polyline at ``x``, null outside (G21): the bracketing segment is an interval join."""
    by = Window.partitionBy(*keys).orderBy("seq")
    seg = profile.select(*keys, F.col("x").alias("xa"), F.col("z").alias("za"), F.lead("x").over(by).alias("xb"), F.lead("z").over(by).alias("zb")).where("xb is not null")
    seg = seg.select(*keys, F.least("xa", "xb").alias("lo"), F.greatest("xa", "xb").alias("hi"), "xa", "za", "xb", "zb")
    a = at.withColumn("__c", F.floor(F.col("at") / 100.0).cast("long"))
    b = seg.withColumn("__c", F.explode(F.sequence(F.floor(F.col("lo") / 100.0).cast("long"), F.floor(F.col("hi") / 100.0).cast("long"))))
    z = F.col("za") + (F.col("at") - F.col("xa")) / (F.col("xb") - F.col("xa")) * (F.col("zb") - F.col("za"))
    hit = a.join(b, [*keys, "__c"]).where(F.col("at").between(F.col("lo"), F.col("hi")) & (F.col("xb") != F.col("xa")))
    best = hit.groupBy(*keys, "at").agg(F.min_by(z, F.col("lo")).alias("z"))
    return at.join(best, [*keys, "at"], "left")


def profiles_compared(one: DataFrame, other: DataFrame, keys: list[str], n: int = 25) -> DataFrame:
    """Mean and greatest deviation of two profiles at ``n`` places of their common extent (J31, U5): full outer on the feature."""
    ends = lambda p, s: p.groupBy(*keys).agg(F.min("x").alias(f"lo{s}"), F.max("x").alias(f"hi{s}"))
    both = ends(one, "1").join(ends(other, "2"), keys, "full")
    lo, hi = F.greatest("lo1", "lo2"), F.least("hi1", "hi2")
    common = F.col("lo1").isNotNull() & F.col("lo2").isNotNull() & (lo < hi)
    at = both.where(common).select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo + (hi - lo) * i / (n - 1))).alias("at"))
    za = interpolated(one, at, keys).withColumnRenamed("z", "z1")
    zb = interpolated(other, at, keys).withColumnRenamed("z", "z2")
    d = za.join(zb, [*keys, "at"]).withColumn("d", F.abs(F.col("z1") - F.col("z2"))).groupBy(*keys).agg(F.mean("d").alias("mean_dev"), F.max("d").alias("max_dev"))
    status = F.when(F.col("lo1").isNull(), "second only").when(F.col("lo2").isNull(), "first only").otherwise("both")
    return both.withColumn("status", status).join(d, keys, "left").select(*keys, "status", "mean_dev", "max_dev")
