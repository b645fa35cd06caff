"""Point patterns: spacing by every convention, hulls, plan grids and their checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.operators.spatial_joins import points_within
from folioscan.storage import materialize


def nearest_neighbour(points: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """``keys, pid, nn, nn_pid``: the nearest other point within a radius, ties to the smaller id (A10)."""
    left = points.select(*keys, F.col("pid").alias("l"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    right = points.select(*keys, F.col("pid").alias("r"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    pairs = points_within(left, right, radius, keys).where("l <> r")
    best = pairs.groupBy(*keys, "l").agg(F.min(F.struct("dist", "r")).alias("m"))
    return best.select(*keys, F.col("l").alias("pid"), F.col("m.dist").alias("nn"), F.col("m.r").alias("nn_pid"))


def _cross(o: tuple, a: tuple, b: tuple) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull by monotone chain, counter-clockwise."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq: Iterator[tuple[float, float]]) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and _cross(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(iter(pts)) + half(reversed(pts))


def area_of(ring: list[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


def tightest_rectangle(ring: list[tuple[float, float]]) -> tuple[float, float, float]:
    """``(area, long side, short side)`` of the least rectangle with a side on a hull edge."""
    best = None
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        n = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5
        if n == 0:
            continue
        ux, uy = (bx - ax) / n, (by - ay) / n
        us = [x * ux + y * uy for x, y in ring]
        vs = [y * ux - x * uy for x, y in ring]
        w, h = max(us) - min(us), max(vs) - min(vs)
        if best is None or w * h < best[0]:
            best = (w * h, max(w, h), min(w, h))
    return best or (0.0, 0.0, 0.0)


def hulls(points: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n_hull, hull_area, rect_area, long_side, short_side``.

    Points are first cut to the extremes of each column of a grid, which no hull point
    escapes, so a group reaches its task reduced by a partial aggregation.
    """
    x = F.col("x")
    extremes = points.groupBy(*keys, x).agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    ends = extremes.select(*keys, "x", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("y"))
    types = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "n_hull int, hull_area double, rect_area double, long_side double, short_side double"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ring = hull(list(zip(pdf["x"], pdf["y"])))
        rect = tightest_rectangle(ring) if len(ring) > 2 else (0.0, 0.0, 0.0)
        return pd.DataFrame([(*key, len(ring), area_of(ring), *rect)], columns=[*keys, "n_hull", "hull_area", "rect_area", "long_side", "short_side"])

    return ends.groupBy(*keys).applyInPandas(run, schema)


def spacing(points: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Nearest-neighbour statistics, density equivalent and dispersion for each group (A10).

    ``density_equivalent`` is the root of hull area over points, null under three points
    or without area; ``r`` the mean nearest distance over half that, clustered under .9
    and regular over 1.1.
    """
    nn = nearest_neighbour(points, keys, radius)
    stats = nn.groupBy(*keys).agg(F.mean("nn").alias("nn_mean"), F.percentile("nn", 0.5).alias("nn_median"), F.min("nn").alias("nn_min"), F.max("nn").alias("nn_max"), F.stddev_pop("nn").alias("nn_std"))
    out = points.groupBy(*keys).agg(F.count("*").alias("n")).join(stats, keys, "left").join(hulls(points, keys), keys, "left")
    dense = F.when((F.col("n") >= 3) & (F.col("hull_area") > 0), F.sqrt(F.col("hull_area") / F.col("n")))
    out = out.withColumn("density_equivalent", dense).withColumn("r", F.try_divide("nn_mean", 0.5 * F.col("density_equivalent")))
    out = out.withColumn("pattern", F.when(F.col("r") < 0.9, "clustered").when(F.col("r") > 1.1, "regular").when(F.col("r").isNotNull(), "random"))
    over = (F.try_divide("hull_area", "rect_area") < 0.6) | (F.try_divide("long_side", "short_side") > 3)
    return out.withColumn("hull_may_overstate_area", F.coalesce(over, F.lit(False)))


def by_class(points: DataFrame) -> DataFrame:
    """The whole set and every class in one pass (A11): ``cls`` null with ``whole`` true is the whole."""
    return (
        points.groupingSets([[], ["cls"]], "cls")
        .agg(F.grouping("cls").cast("boolean").alias("whole"), F.count("*").alias("n"), F.mean("x").alias("mean_x"), F.mean("y").alias("mean_y"), F.stddev_pop("x").alias("std_x"))
    )


def spacing_candidates(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Each convention's spacing as a row, and whether the choice matters."""
    names = ("nn_mean", "nn_median", "density_equivalent")
    rows = F.array(*(F.struct(F.lit(n).alias("convention"), F.col(n).alias("spacing")) for n in names))
    spread = F.try_divide(F.greatest(*names), F.least(*names))
    return stats.select(*keys, (spread > 1.15).alias("choice_matters"), F.inline(rows)).where("spacing is not null")


def merge_coincident(points: DataFrame, keys: list[str], tol: float) -> DataFrame:
    """One point for each chain of points within ``tol`` of each other (A13): the least id's place, and how many merged.

    Chains are the connected components of the pairs within reach, found by rounds of least
    ids with pointer jumping.  Ids are unique.
    """
    a = points.select(*keys, F.col("pid").alias("a"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    b = points.select(*keys, F.col("pid").alias("b"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    links = materialize(points_within(a, b, tol, keys).where("a <> b").select("a", "b"), "merge")
    label = materialize(points.select(F.col("pid").alias("a"), F.col("pid").alias("root")), "merge")
    while True:
        seen = links.join(label.select(F.col("a").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        nxt = materialize(label.join(seen, "a", "left").select("a", F.col("root").alias("old"), F.least("root", "near").alias("root")), "merge")
        up = nxt.select(F.col("a").alias("k"), F.col("root").alias("up"))
        label = materialize(nxt.join(up, F.col("root") == F.col("k")).select("a", "old", F.col("up").alias("root")), "merge")
        if label.where("old <> root").isEmpty():
            break
        label = label.drop("old")
    p = F.struct("x", "y")
    got = points.join(label.select("a", "root"), F.col("pid") == F.col("a")).groupBy(*keys, "root").agg(F.min_by(p, "pid").alias("p"), F.count("*").alias("merged"))
    return got.select(*keys, F.col("root").alias("pid"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), "merged")


def similarity_fit(controls: DataFrame, keys: list[str]) -> DataFrame:
    """The least-squares similarity from page to ground for each set (A22), right-handed and mirrored.

    ``(e + i n) = a z + b`` with ``z = px - i py`` (page y runs down) or, mirrored, its
    conjugate.  Both have closed forms in sums, so they are one aggregation.
    """
    n = F.count("*").cast("double")
    x, y, e, h = F.col("px"), -F.col("py"), F.col("easting"), F.col("northing")
    sums = {"sx": x, "sy": y, "se": e, "sh": h, "szz": x * x + y * y, "sww": e * e + h * h, "xe": x * e, "yh": y * h, "xh": x * h, "ye": y * e}
    s = controls.groupBy(*keys).agg(n.alias("n"), *(F.sum(v).alias(k) for k, v in sums.items()))
    c = F.col
    var = c("szz") - (c("sx") * c("sx") + c("sy") * c("sy")) / c("n")
    cov = {k: c(k) - c(a) * c(b) / c("n") for k, a, b in (("xe", "sx", "se"), ("yh", "sy", "sh"), ("xh", "sx", "sh"), ("ye", "sy", "se"))}
    total = c("sww") - (c("se") * c("se") + c("sh") * c("sh")) / c("n")
    re, im = (cov["xe"] + cov["yh"]) / var, (cov["xh"] - cov["ye"]) / var
    re_m, im_m = (cov["xe"] - cov["yh"]) / var, (cov["xh"] + cov["ye"]) / var

    def rms(p, q):
        return F.sqrt(F.greatest(total - (p * p + q * q) * var, F.lit(0.0)) / c("n"))

    out = s.where(var > 0).select(*keys, "n", re.alias("re"), im.alias("im"), ((c("se") - re * c("sx") + im * c("sy")) / c("n")).alias("b_re"), ((c("sh") - im * c("sx") - re * c("sy")) / c("n")).alias("b_im"), rms(re, im).alias("rms"), rms(re_m, im_m).alias("rms_mirror"), F.sqrt(re * re + im * im).alias("scale"), F.sqrt(total / c("n")).alias("spread"))
    mirrored = (c("n") >= 3) & (c("rms") > F.greatest(3 * c("rms_mirror"), 0.002 * c("spread")))
    return out.withColumn("mirrored", mirrored).drop("spread")


def to_ground(points: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """Points ``(px, py)`` with ``easting`` and ``northing`` by their set's fit (G16); mirrored fits give null."""
    p = points.join(fits.select(*keys, "re", "im", "b_re", "b_im", "mirrored"), keys)
    x, y = F.col("px"), -F.col("py")
    e, h = F.col("re") * x - F.col("im") * y + F.col("b_re"), F.col("im") * x + F.col("re") * y + F.col("b_im")
    ok = ~F.col("mirrored")
    return p.withColumn("easting", F.when(ok, e)).withColumn("northing", F.when(ok, h)).drop("re", "im", "b_re", "b_im", "mirrored")


def check_points(points: DataFrame, symbols: DataFrame, tol: float, keys: list[str] = ()) -> DataFrame:
    """``keys, pid, same_point, on_symbol, flag`` (J16): points too near each other, and points on no symbol."""
    a = points.select(*keys, F.col("pid").alias("l"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    near = points_within(a, points.select(*keys, F.col("pid").alias("r"), F.col("x").alias("rx"), F.col("y").alias("ry")), tol, keys).where("l <> r")
    twin = near.groupBy(*keys, F.col("l").alias("pid")).agg(F.min("r").alias("same_point"))
    on = points_within(a, symbols.select(*keys, F.col("sid"), F.col("x").alias("rx"), F.col("y").alias("ry")), tol, keys)
    on = on.groupBy(*keys, F.col("l").alias("pid")).agg(F.min_by("sid", F.struct("dist", "sid")).alias("on_symbol"))
    out = points.select(*keys, "pid").join(twin, [*keys, "pid"], "left").join(on, [*keys, "pid"], "left")
    flag = F.when(F.col("same_point").isNotNull(), "same point").when(F.col("on_symbol").isNull(), "not on a symbol").otherwise("ok")
    return out.withColumn("flag", flag)


def offset_votes(anchors: DataFrame, ends: DataFrame, reach: float, bin_pt: float = 2.0, keys: list[str] = ()) -> DataFrame:
    """The modal translation between anchors and endpoints of each page (J24, A24): ``keys``, bin, votes, and whether it is significant."""
    near = points_within(anchors, ends, reach, keys)
    # an anchor votes once for a bin, however many ends lie there
    to_bin = lambda a, b: F.bround((F.col(b) - F.col(a)) / bin_pt).cast("long")
    pairs = near.select(*keys, "lx", "ly", to_bin("lx", "rx").alias("bx"), to_bin("ly", "ry").alias("by")).distinct()
    bins = pairs.groupBy(*keys, "bx", "by").agg(F.count("*").alias("votes"))
    first = F.max_by(F.struct("bx", "by", "votes"), F.struct("votes", (-F.col("bx")).alias("x"), (-F.col("by")).alias("y"))).alias("m")
    top = bins.groupBy(*keys).agg(first, F.sum("votes").alias("total"), F.count("*").alias("n_bins")).where("n_bins > 0")
    top = top.select(*keys, "m.*", "total", "n_bins")
    mean = F.col("total") / F.col("n_bins")
    # Chernoff bound of a Poisson count, over all bins
    bound = F.log("n_bins") + F.col("votes") - mean - F.col("votes") * F.log(F.col("votes") / mean)
    return top.withColumn("significant", (F.col("votes") > mean) & (bound < F.log(F.lit(1e-6))))


def rank_by(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group in a total order (O3, O5, W20), with ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
