"""Page facts from line-work, calibration, principal axes and snapped endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import geometry as G
from folioscan.operators import slices as S
from folioscan.operators.spatial_joins import points_within
from folioscan.storage import materialize

#: A rule is longer than 20 points and strays less than half a point.
RULE_LENGTH, RULE_STRAY = 20.0, 0.5


def drawing_facts(segments: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n_paths, ruling_h, ruling_v, layers`` of every page (A4), in one aggregation.

    Horizontal and vertical rules are counted; ``layers`` are the distinct names that are
    not null or empty, sorted.
    """
    across, down = F.abs(F.col("ex") - F.col("ax")), F.abs(F.col("ey") - F.col("ay"))
    named = F.when(F.col("layer") != "", F.col("layer"))
    return segments.groupBy(*keys).agg(
        F.count("*").alias("n_paths"),
        F.count_if((down < RULE_STRAY) & (across > RULE_LENGTH)).alias("ruling_h"),
        F.count_if((across < RULE_STRAY) & (down > RULE_LENGTH)).alias("ruling_v"),
        F.array_sort(F.collect_set(named)).alias("layers"),
    )


def calibrated(x0: Column, y0: Column, x1: Column, y1: Column, real: Column) -> Column:
    """Real length of one drawing unit from two points and the distance between them.

    Null where the points coincide or the distance is not positive.
    """
    apart = G.distance(x0, y0, x1, y1)
    return F.when((real > 0) & (apart > 0), real / apart)


def principal_axes(points: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, dx, dy, elongation``: the unit major axis of each set of points ``(x, y)``.

    Closed forms of the 2 by 2 covariance.  A single point has the axis (1, 0) and
    elongation 1; a set without cross-covariance has the axis of its wider extent.
    """
    s = points.groupBy(*keys).agg(F.count("*").alias("n"), F.var_pop("x").alias("__a"), F.var_pop("y").alias("__b"), F.covar_pop("x", "y").alias("__c"))
    a, b, c = F.col("__a"), F.col("__b"), F.col("__c")
    mid, root = (a + b) / 2, F.sqrt(((a - b) / 2) ** 2 + c * c)
    major, minor = mid + root, F.greatest(mid - root, F.lit(1e-12))
    length = F.sqrt((major - b) ** 2 + c * c)
    tilted = F.abs(c) > 1e-12
    dx = F.when(F.col("n") < 2, 1.0).when(tilted, (major - b) / length).when(a >= b, 1.0).otherwise(0.0)
    dy = F.when(F.col("n") < 2, 0.0).when(tilted, c / length).when(a >= b, 0.0).otherwise(1.0)
    spread = F.when(F.col("n") < 2, 1.0).otherwise(F.sqrt(major / minor))
    return s.select(*keys, "n", dx.alias("dx"), dy.alias("dy"), spread.alias("elongation"))


def snapped_ends(segments: DataFrame, keys: list[str], tol: float) -> DataFrame:
    """``keys, id, which, leader, x, y``: every end of a segment at the centre of its cluster.

    In the order of id and end, an end joins the first leader within ``tol`` or becomes a
    leader itself.  Rounds settle it: an end whose earlier neighbours are all settled leads
    if none of them does.  ``leader`` is twice the id of the leading end, plus its number.
    """
    ends = S.ends(segments, keys).select(*keys, "id", "which", (F.col("id") * 2 + F.col("which")).alias("end"), F.col("rx").alias("x"), F.col("ry").alias("y"))
    late = ends.select(*keys, F.col("end").alias("late"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    early = ends.select(*keys, F.col("end").alias("early"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    links = materialize(points_within(late, early, tol, keys).where("early < late").select("late", "early"), "snap")
    state = materialize(ends.select("end", F.lit(None).cast("boolean").alias("leads")), "snap")
    while not state.where("leads is null").isEmpty():
        seen = links.join(state.withColumnRenamed("end", "early"), "early").groupBy(F.col("late").alias("end"))
        seen = seen.agg(F.coalesce(F.bool_or("leads"), F.lit(False)).alias("led"), F.count_if(F.col("leads").isNull()).alias("open"))
        nxt = state.join(seen, "end", "left")
        settled = F.when(F.col("led"), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        state = materialize(nxt.select("end", F.coalesce("leads", settled).alias("leads")), "snap")
    heads = state.where("leads").select(F.col("end").alias("early"))
    joins = links.join(heads, "early").groupBy(F.col("late").alias("end")).agg(F.min("early").alias("leader"))
    joined = ends.join(joins, "end", "left").withColumn("leader", F.coalesce("leader", "end"))
    centre = joined.groupBy("leader").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return joined.drop("x", "y", "end").join(centre, "leader").select(*keys, "id", "which", "leader", "x", "y")
