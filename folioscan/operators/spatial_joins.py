"""Range, nearest, containment and interval joins over grid cells.

A radius or a box is met through the cells of a uniform grid: one side says which cell
it is in, the other which cells it reaches, and an equality join on the cell is followed
by the exact test.  No plan has a Cartesian product.  Rows a side repeats over cells are
told apart by ids, so a pair is found once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import geometry as G


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def reached(lo: Column, hi: Column, size: float) -> Column:
    """The cells from ``lo`` to ``hi``."""
    return F.sequence(cell(lo, size), cell(hi, size))


def points_within(left: DataFrame, right: DataFrame, radius: float, keys: list[str] = ()) -> DataFrame:
    """Pairs of a left point ``(lx, ly)`` and a right point ``(rx, ry)`` within a radius, with ``dist``.

    The columns of both sides must differ but for ``keys``, which are equated.
    """
    # sums round to either side, so cells are reached for a little farther than the exact test
    wide = radius * (1 + 1e-9)
    a = left.withColumn("__cx", cell(F.col("lx"), radius)).withColumn("__cy", cell(F.col("ly"), radius))
    b = right.withColumn("__cx", F.explode(reached(F.col("rx") - wide, F.col("rx") + wide, radius)))
    b = b.withColumn("__cy", F.explode(reached(F.col("ry") - wide, F.col("ry") + wide, radius)))
    both = a.join(b, [*keys, "__cx", "__cy"]).drop("__cx", "__cy")
    return both.withColumn("dist", G.distance(F.col("lx"), F.col("ly"), F.col("rx"), F.col("ry"))).where(F.col("dist") <= radius)


def nearest_within(left: DataFrame, right: DataFrame, radius: float, keys: list[str], tie: Column) -> DataFrame:
    """``keys, lx, ly, near``: for each left place the least ``(dist, tie)`` of right points within a radius.

    ``tie`` is made of the right side's columns; places that reach nothing are left out.  Points
    at one place are one row, and radii double from a 64th: a place leaves as soon as it has
    met anything, so no place is paired with all that lies within the whole radius.
    """
    from folioscan.storage import materialize

    at = [*keys, "lx", "ly"]
    todo = materialize(left.select(*at).distinct(), "near")
    there = materialize(right.groupBy(*keys, "rx", "ry").agg(F.min(tie).alias("__tie")), "near")
    found, reach = None, radius / 64
    while True:
        got = points_within(todo, there, reach, keys).groupBy(*at).agg(F.min(F.struct("dist", F.col("__tie").alias("tie"))).alias("near"))
        got = materialize(got, "near")
        found = got if found is None else found.unionByName(got)
        todo = materialize(todo.join(got.select(*at), at, "left_anti"), "near")
        if reach >= radius or todo.isEmpty():
            return found
        reach = min(2 * reach, radius)


def count_within(left: DataFrame, right: DataFrame, radius: float, keys: list[str] = ()) -> DataFrame:
    """``keys, lx, ly, n``: how many right points each left place has within a radius, where it has any.

    Cells of a 16th of the radius that lie wholly within it are counted as one; only the points
    of cells on the rim are tested.
    """
    size = radius / 16
    at, cells = [*keys, "lx", "ly"], [*keys, "__ix", "__iy"]
    places = left.select(*at).distinct()
    points = right.groupBy(*keys, "rx", "ry").agg(F.count("*").alias("__w")).withColumn("__ix", cell(F.col("rx"), size)).withColumn("__iy", cell(F.col("ry"), size))
    held = points.groupBy(*cells).agg(F.sum("__w").alias("__n"), *(f(c).alias(f"__{c}{k}") for c in ("rx", "ry") for k, f in ((0, F.min), (1, F.max))))
    wide = radius * (1 + 1e-9)
    a = places.withColumn("__cx", cell(F.col("lx"), radius)).withColumn("__cy", cell(F.col("ly"), radius))
    b = held.withColumn("__cx", F.explode(reached(F.col("__rx0") - wide, F.col("__rx1") + wide, radius)))
    b = b.withColumn("__cy", F.explode(reached(F.col("__ry0") - wide, F.col("__ry1") + wide, radius)))
    x, y = F.col("lx"), F.col("ly")
    gap = lambda v, lo, hi: F.greatest(F.col(lo) - v, v - F.col(hi), F.lit(0.0))
    span = lambda v, lo, hi: F.greatest(v - F.col(lo), F.col(hi) - v)
    least = F.hypot(gap(x, "__rx0", "__rx1"), gap(y, "__ry0", "__ry1"))
    most = F.hypot(span(x, "__rx0", "__rx1"), span(y, "__ry0", "__ry1"))
    met = a.join(b, [*keys, "__cx", "__cy"]).withColumn("__in", most <= radius * (1 - 1e-9)).where(F.col("__in") | (least <= wide))
    whole = met.where("__in").select(*at, F.col("__n").alias("n"))
    rim = met.where("not __in").select(*at, "__ix", "__iy").join(points, cells)
    rim = rim.where(G.distance(x, y, F.col("rx"), F.col("ry")) <= radius).select(*at, F.col("__w").alias("n"))
    return whole.groupBy(*at).agg(F.sum("n").alias("n")).unionByName(rim.groupBy(*at).agg(F.sum("n").alias("n"))).groupBy(*at).agg(F.sum("n").alias("n"))


def points_in_rings(left: DataFrame, right: DataFrame, radius: Column, keys: list[str] = ()) -> DataFrame:
    """Pairs within a radius of the left point's own, with ``dist``.

    Left points are dealt by the power of two above their radius; each such level has
    cells of its size, and right points say for each level that occurs which cell they
    are in.  A left point reaches nine cells, whatever its radius.
    """
    level = F.greatest(F.ceil(F.log2(F.greatest(radius, F.lit(1e-9)))), F.lit(-20)).cast("int")
    a = left.withColumn("__radius", radius).withColumn("__level", level).withColumn("__size", F.pow(F.lit(2.0), F.col("__level")))
    levels = a.select("__level").distinct()  # at most some dozens, by construction
    step = lambda v, d: F.floor(F.col(v) / F.col("__size")).cast("long") + d
    near = F.sequence(F.lit(-1), F.lit(1))
    a = a.withColumn("__dx", F.explode(near)).withColumn("__dy", F.explode(near)).withColumn("__cx", step("lx", F.col("__dx"))).withColumn("__cy", step("ly", F.col("__dy"))).drop("__dx", "__dy", "__size")
    b = right.crossJoin(F.broadcast(levels)).withColumn("__size", F.pow(F.lit(2.0), F.col("__level"))).withColumn("__cx", step("rx", F.lit(0))).withColumn("__cy", step("ry", F.lit(0))).drop("__size")
    # sizes are estimated before rows are repeated over cells, so that side would be broadcast too large
    both = a.hint("merge").join(b, [*keys, "__level", "__cx", "__cy"]).drop("__level", "__cx", "__cy")
    both = both.withColumn("dist", G.distance(F.col("lx"), F.col("ly"), F.col("rx"), F.col("ry")))
    return both.where(F.col("dist") <= F.col("__radius")).drop("__radius")


def nearest_in_rings(left: DataFrame, right: DataFrame, radius: Column, keys: list[str], tie: Column) -> DataFrame:
    """``keys, lx, ly, near``: for each left place the least ``(dist, tie)`` of right points within the largest radius of its left points.

    As ``nearest_within``, with a radius of each left point's own: what lies beyond a point's
    radius is for the caller to drop.
    """
    from folioscan.storage import materialize

    at = [*keys, "lx", "ly"]
    todo = materialize(left.groupBy(*at).agg(F.max(radius).alias("__most")), "near")
    there = materialize(right.groupBy(*keys, "rx", "ry").agg(F.min(tie).alias("__tie")), "near")
    found = None
    for part in (64, 32, 16, 8, 4, 2, 1):
        # searched a little wider than the exact test, as sums round to either side
        reach = F.col("__most") / part
        got = points_in_rings(todo, there, reach * (1 + 1e-9), keys).where(F.col("dist") <= reach)
        got = materialize(got.groupBy(*at).agg(F.min(F.struct("dist", F.col("__tie").alias("tie"))).alias("near")), "near")
        found = got if found is None else found.unionByName(got)
        if part > 1:
            todo = materialize(todo.join(got.select(*at), at, "left_anti"), "near")
            if todo.isEmpty():
                break
    return found


def points_on_rings(left: DataFrame, right: DataFrame, radius: Column, slack: float, keys: list[str] = ()) -> DataFrame:
    """Pairs of a left point and the right points ``slack`` of its radius or less from its ring, with ``dist``.

    As ``points_in_rings``, with cells of a quarter of the level's size, so that a left point
    reaches only the cells that its ring runs through.  ``slack`` is below one.
    """
    level = F.greatest(F.ceil(F.log2(F.greatest(radius, F.lit(1e-9)))), F.lit(-20)).cast("int")
    a = left.withColumn("__radius", radius).withColumn("__level", level).withColumn("__size", F.pow(F.lit(2.0), F.col("__level") - 2))
    levels = a.select("__level").distinct()  # at most some dozens, by construction
    step = lambda v: F.floor(F.col(v) / F.col("__size")).cast("long")
    most = int(4 * (1 + slack)) + 1
    moves = F.array(*(F.struct(F.lit(dx).alias("x"), F.lit(dy).alias("y")) for dx in range(-most, most + 1) for dy in range(-most, most + 1)))
    a = a.withColumn("__m", F.explode(moves)).withColumn("__cx", F.try_add(step("lx"), F.col("__m.x"))).withColumn("__cy", F.try_add(step("ly"), F.col("__m.y"))).drop("__m")
    # the nearest and the farthest that a point of the cell can be; both are taken a little wider than they are
    gap = lambda v, c: F.greatest(F.col(c) * F.col("__size") - F.col(v), F.col(v) - (F.col(c) + 1) * F.col("__size"), F.lit(0.0))
    span = lambda v, c: F.greatest(F.col(v) - F.col(c) * F.col("__size"), (F.col(c) + 1) * F.col("__size") - F.col(v))
    wide = F.col("__size") * 1e-6
    near = F.hypot(gap("lx", "__cx"), gap("ly", "__cy")) <= (1 + slack) * F.col("__radius") + wide
    far = F.hypot(span("lx", "__cx"), span("ly", "__cy")) >= (1 - slack) * F.col("__radius") - wide
    a = a.where(near & far).drop("__size")
    b = right.crossJoin(F.broadcast(levels)).withColumn("__size", F.pow(F.lit(2.0), F.col("__level") - 2)).withColumn("__cx", step("rx")).withColumn("__cy", step("ry")).drop("__size")
    # sizes are estimated before rows are repeated over cells, so that side would be broadcast too large
    both = a.hint("merge").join(b, [*keys, "__level", "__cx", "__cy"]).drop("__level", "__cx", "__cy")
    both = both.withColumn("dist", G.distance(F.col("lx"), F.col("ly"), F.col("rx"), F.col("ry")))
    return both.where(F.abs(F.col("dist") - F.col("__radius")) <= slack * F.col("__radius")).drop("__radius")


def boxes_meeting(left: DataFrame, right: DataFrame, size: float, keys: list[str] = (), test: str = "intersect") -> DataFrame:
    """Pairs of left boxes (``l`` columns) and right boxes (``r`` columns) that intersect, or where left contains right.

    A pair meets in each common cell and counts in the first of them.
    """
    a = left.withColumn("__cx", F.explode(reached(F.col("lx0"), F.col("lx1"), size))).withColumn("__cy", F.explode(reached(F.col("ly0"), F.col("ly1"), size)))
    b = right.withColumn("__cx", F.explode(reached(F.col("rx0"), F.col("rx1"), size))).withColumn("__cy", F.explode(reached(F.col("ry0"), F.col("ry1"), size)))
    both = a.join(b, [*keys, "__cx", "__cy"])
    lb, rb = G.box("l"), G.box("r")
    once = (F.col("__cx") == F.greatest(cell(lb[0], size), cell(rb[0], size))) & (F.col("__cy") == F.greatest(cell(lb[1], size), cell(rb[1], size)))
    return both.where(once & (G.contains(lb, rb) if test == "contain" else G.intersects(lb, rb))).drop("__cx", "__cy")


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float, keys: list[str] = ()) -> DataFrame:
    """Pairs of points ``(px, py)`` and boxes that hold them, edges included."""
    a = points.withColumn("__cx", cell(F.col("px"), size)).withColumn("__cy", cell(F.col("py"), size))
    b = boxes.withColumn("__cx", F.explode(reached(F.col("x0"), F.col("x1"), size))).withColumn("__cy", F.explode(reached(F.col("y0"), F.col("y1"), size)))
    x, y = F.col("px"), F.col("py")
    return a.join(b, [*keys, "__cx", "__cy"]).drop("__cx", "__cy").where(x.between(F.col("x0"), F.col("x1")) & y.between(F.col("y0"), F.col("y1")))


def nearest(left: DataFrame, right: DataFrame, k: int, keys: list[str], left_id: str, right_id: str, start: float, most: float) -> DataFrame:
    """The ``k`` nearest right points of every left point within ``most``, ties to the smaller id, with ``dist`` and ``rank``.

    Radii double from ``start``: a left point leaves as soon as it has ``k`` within the
    radius, so dense places never search wide.
    """
    found, todo, radius = None, left, start
    while True:
        pairs = points_within(todo, right, radius, keys)
        by = Window.partitionBy(*keys, left_id)
        ranked = pairs.withColumn("rank", F.row_number().over(by.orderBy("dist", right_id))).where(F.col("rank") <= k)
        last = radius >= most
        done = ranked if last else ranked.withColumn("__n", F.count("*").over(by)).where(F.col("__n") >= k).drop("__n")
        found = done if found is None else found.unionByName(done)
        if last:
            return found
        todo = todo.join(done.select(*keys, left_id).distinct(), [*keys, left_id], "left_anti")
        radius = min(radius * 2, most)


def intervals(points: DataFrame, bands: DataFrame, value: str, lo: str, hi: str, size: float, keys: list[str] = ()) -> DataFrame:
    """Pairs of a value and the bands ``lo <= value < hi`` that hold it."""
    a = points.withColumn("__c", cell(F.col(value), size))
    b = bands.withColumn("__c", F.explode(reached(F.col(lo), F.col(hi), size)))
    return a.join(b, [*keys, "__c"]).drop("__c").where((F.col(value) >= F.col(lo)) & (F.col(value) < F.col(hi)))


def greedy_pairs(pairs: DataFrame, keys: list[str], left: str, right: str, dist: str = "dist") -> DataFrame:
    """One-to-one matching, closest pairs first (J15); ties by left, then right.

    Rounds of mutual best: a pair that is the best left of both its ends is what the
    greedy order would take next among its ends, so the rounds give the greedy result.
    """
    from folioscan.storage import materialize

    rest, out = materialize(pairs, "greedy"), None
    while True:
        rank = F.struct(dist, left, right)
        best_l = rest.groupBy(*keys, left).agg(F.min(rank).alias("__bl"))
        best_r = rest.groupBy(*keys, right).agg(F.min(rank).alias("__br"))
        both = rest.join(best_l, [*keys, left]).join(best_r, [*keys, right]).where((F.col("__bl") == rank) & (F.col("__br") == rank))
        taken = materialize(both.select(*rest.columns), "greedy")
        if taken.isEmpty():
            return out if out is not None else taken
        out = taken if out is None else out.unionByName(taken)
        rest = rest.join(taken.select(*keys, left), [*keys, left], "left_anti").join(taken.select(*keys, right), [*keys, right], "left_anti")
        rest = materialize(rest.select(*pairs.columns), "greedy")
