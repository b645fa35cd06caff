"""Operators over ordered rows: islands, carried values, runs, regular steps, joined pieces."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list, starts: Column, name: str = "island") -> DataFrame:
    """``df`` with the number of its run, from 0; a run begins at the first row and wherever ``starts`` holds."""
    by = Window.partitionBy(*keys).orderBy(*order)
    flag = F.when(F.row_number().over(by) == 1, 1).when(F.coalesce(starts, F.lit(False)), 1).otherwise(0)
    return df.withColumn("__s", flag).withColumn(name, (F.sum("__s").over(by) - 1).cast("int")).drop("__s")


def carried(df: DataFrame, keys: list[str], order: list, value: str, eligible: Column, source: Column, name: str) -> DataFrame:
    """``value`` where a row is a source, else the last source's while every row since was eligible.

    Chains forward: an eligible row directly after a source, or after such a row, takes it.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    state = F.when(source, F.struct(F.col(value).alias("v"))).when(eligible, None).otherwise(F.struct(F.lit(None).cast("string").alias("v")))
    last = F.last(state, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, last["v"])


def joined_pieces(pieces: DataFrame, keys: list[str], max_gap: float) -> DataFrame:
    """Pieces ``lo, hi`` on one line joined where the gap is no more than ``max_gap`` (W11): ``lo, hi, n``."""
    by = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    run = islands(pieces.withColumn("__r", reach), keys, ["lo", "hi"], F.col("lo") - F.col("__r") > max_gap)
    return run.groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n")).drop("island")


def steps_even(runs: DataFrame, keys: list[str], order: str, value: str, tol: float = 1e-6) -> DataFrame:
    """Whether a run's steps equal its least step, double steps allowed for a third of them."""
    step = F.lead(value).over(Window.partitionBy(*keys).orderBy(order)) - F.col(value)
    s = runs.withColumn("step", step).where("step is not null")
    s = s.withColumn("base", F.min(F.abs("step")).over(Window.partitionBy(*keys)))
    ratio = F.try_divide(F.abs("step"), "base")
    agg = s.groupBy(*keys).agg(F.min("base").alias("base"), F.count("*").alias("n_steps"), F.count_if(F.abs(ratio - 2) <= tol).alias("n_double"), F.count_if(ratio.isNull() | ((F.abs(ratio - 1) > tol) & (F.abs(ratio - 2) > tol))).alias("n_odd"))
    return agg.withColumn("even", (F.col("base") > 0) & (F.col("n_odd") == 0) & (F.col("n_double") * 3 <= F.col("n_steps")))


def grid_step(positions: DataFrame, keys: list[str], value: str, tol: float = 0.08) -> DataFrame:
    """The grid step that explains most gaps, and every position's index.

    Candidates are the gaps between neighbours and their halves; a gap fits if it is
    within ``tol`` of a whole number of steps; ties go to the larger step.
    """
    gap = F.lead(value).over(Window.partitionBy(*keys).orderBy(value)) - F.col(value)
    gaps = positions.withColumn("gap", gap).where("gap > 0").select(*keys, "gap")
    cands = gaps.select(*keys, F.explode(F.array(F.col("gap"), F.col("gap") / 2)).alias("step")).distinct()
    ratio = F.col("gap") / F.col("step")
    near = (F.bround(ratio) >= 1) & (F.abs(ratio - F.bround(ratio)) <= tol)
    scored = gaps.join(cands, keys).groupBy(*keys, "step").agg(F.count_if(near).alias("fits"), F.count("*").alias("gaps"))
    best = scored.groupBy(*keys).agg(F.max_by(F.struct("step", "fits", "gaps"), F.struct("fits", "step")).alias("b")).select(*keys, "b.*")
    first = positions.withColumn("__first", F.min(value).over(Window.partitionBy(*keys)))
    return first.join(best, keys).withColumn("index", F.bround((F.col(value) - F.col("__first")) / F.col("step")).cast("int")).drop("__first")


def _longest(values: list[float], sign: int) -> list[int]:
    best, back = [1] * len(values), [-1] * len(values)
    for i in range(len(values)):
        for j in range(i):
            if sign * values[j] < sign * values[i] and best[j] + 1 > best[i]:
                best[i], back[i] = best[j] + 1, j
    i, out = max(range(len(values)), key=lambda k: best[k], default=-1), []
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def monotone_run(runs: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """The longest strictly rising or falling run of values in order of position (W7); ties rise, then come first."""
    types = {f.name: f.dataType.simpleString() for f in runs.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in runs.columns) + ", rising boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf[value].notna()].sort_values(position, kind="stable")
        up, down = _longest(list(pdf[value]), 1), _longest(list(pdf[value]), -1)
        kept = pdf.iloc[up if len(up) >= len(down) else down].copy()
        kept["rising"] = len(up) >= len(down)
        return kept

    return runs.groupBy(*keys).applyInPandas(run, schema)


def fit_scales(runs: DataFrame, keys: list[str], position: str, value: str, least: int = 3) -> DataFrame:
    """A line through a run of labels (G12, A21): slope, intercept, residual, kept and dropped, or a refusal.

    Values must rise or fall over 60 % of the points; the greatest residual must be within
    a fifth of the median step; one point may be dropped while four are left.
    """
    types = {f.name: f.dataType.simpleString() for f in runs.schema.fields}
    names = [*keys, "slope", "intercept", "max_residual", "kept", "dropped", "refusal"]
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", slope double, intercept double, max_residual double, kept int, dropped int, refusal string"

    def line(x: pd.Series, y: pd.Series) -> tuple[float, float, pd.Series]:
        mx, my = x.mean(), y.mean()
        b = ((x - mx) * (y - my)).sum() / ((x - mx) ** 2).sum()
        return b, my - b * mx, (y - my - b * (x - mx)).abs()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf[value].notna()].sort_values(position, kind="stable").drop_duplicates(position)
        n = len(pdf)
        up, down = _longest(list(pdf[value]), 1), _longest(list(pdf[value]), -1)
        kept = pdf.iloc[up if len(up) >= len(down) else down]
        refusal = None
        if len(kept) < max(least, 2):
            refusal = "too few labels"
        elif len(kept) < 0.6 * n:
            refusal = "not monotone"
        if refusal is None:
            step = kept[value].diff().abs().median()
            b, a, res = line(kept[position], kept[value])
            if res.max() > 0.2 * step and len(kept) > 4:
                trial = kept.drop(res.idxmax())
                b2, a2, res2 = line(trial[position], trial[value])
                if res2.max() <= 0.2 * step:
                    kept, b, a, res = trial, b2, a2, res2
            if res.max() > 0.2 * step:
                refusal = "residual too large"
        row = (*key, None, None, None, len(kept), n - len(kept), refusal) if refusal else (*key, b, a, res.max(), len(kept), n - len(kept), None)
        return pd.DataFrame([row], columns=names)

    return runs.groupBy(*keys).applyInPandas(run, schema)


def vertices_cleaned(vertices: Column, tol: float = 1e-6) -> Column:
    """A vertex array without repeats of the last kept vertex."""

    def step(kept: Column, v: Column) -> Column:
        last = F.element_at(kept, -1)
        near = (F.abs(v["x"] - last["x"]) <= tol) & (F.abs(v["y"] - last["y"]) <= tol)
        return F.when(F.size(kept) == 0, F.array(v)).when(near, kept).otherwise(F.concat(kept, F.array(v)))

    return F.aggregate(vertices, F.slice(vertices, 1, 0), step)


def joined_polylines(lines: DataFrame, keys: list[str], tol: float = 1e-3) -> DataFrame:
    """Polylines chained end to end, reversed where needed (W18): ``keys, chain, ids, xs, ys``.

    Greedy in order of id; ends are looked up on a grid of the tolerance.
    """
    types = {f.name: f.dataType.simpleString() for f in lines.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", chain int, ids array<bigint>, xs array<double>, ys array<double>"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        left = {int(r.id): list(zip(r.xs, r.ys)) for r in pdf.itertuples() if len(r.xs) > 1}
        ends: dict[tuple, set] = {}

        def at(p: tuple) -> tuple:
            return round(p[0] / tol), round(p[1] / tol)

        for i, line in left.items():
            for p in (line[0], line[-1]):
                ends.setdefault(at(p), set()).add(i)
        rows = []
        while left:
            first = min(left)
            ids, path = [first], left.pop(first)
            for turned in (False, True):
                while True:
                    i = min((j for j in ends.get(at(path[-1]), ()) if j in left), default=None)
                    if i is None:
                        break
                    line = left.pop(i)
                    path += (line if at(line[0]) == at(path[-1]) else line[::-1])[1:]
                    ids.append(i)
                path.reverse()
            rows.append((*key, len(rows), ids, [p[0] for p in path], [p[1] for p in path]))
        return pd.DataFrame(rows, columns=[*keys, "chain", "ids", "xs", "ys"])

    return lines.groupBy(*keys).applyInPandas(run, schema)


def suppressed(hits: DataFrame, keys: list[str], most: int = 400) -> DataFrame:
    """Non-maximum suppression of scored boxes (O4): best first; a hit goes if a third of the smaller
    box is covered by a kept one, or any of it by one better by over .2; a cap for each group."""
    types = [f"{f.name} {f.dataType.simpleString()}" for f in hits.schema.fields]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        kept: list[int] = []
        for i, r in pdf.iterrows():
            ok = True
            for j in kept:
                k = pdf.loc[j]
                w, h = min(r.x1, k.x1) - max(r.x0, k.x0), min(r.y1, k.y1) - max(r.y0, k.y0)
                if w > 0 and h > 0:
                    small = min((r.x1 - r.x0) * (r.y1 - r.y0), (k.x1 - k.x0) * (k.y1 - k.y0))
                    if (small > 0 and w * h / small >= 0.33) or k.score - r.score > 0.2:
                        ok = False
                        break
            if ok:
                kept.append(i)
            if len(kept) >= most:
                break
        return pdf.loc[kept]

    return hits.groupBy(*keys).applyInPandas(run, ", ".join(types))
