"""Slices of a drawing's entities and the questions a point or a text asks of them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import geometry as G


def in_window(entities: DataFrame, x0: float, y0: float, x1: float, y1: float, mode: str = "intersect", kind: str | None = None) -> DataFrame:
    """Entities whose box meets a window, or lies in it; corners in any order, null boxes never."""
    if mode not in ("intersect", "contain"):
        raise ValueError("mode is intersect or contain")
    w = tuple(map(F.lit, (min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1))))
    b = G.box()
    out = entities.where(G.contains(w, b) if mode == "contain" else G.intersects(w, b))
    return out.where(F.col("kind") == kind) if kind else out


def on_layer(entities: DataFrame, layer: str) -> DataFrame:
    return entities.where(F.col("layer") == layer)


def by_color(entities: DataFrame, color: str) -> DataFrame:
    return entities.where(F.lower("color") == color.lower())


def by_angle(segments: DataFrame, lo: float, hi: float) -> DataFrame:
    """Segments whose folded orientation is in a band that may wrap (P3), with ``angle``."""
    s = segments.withColumn("angle", G.direction(*map(F.col, ("ax", "ay", "ex", "ey"))))
    return s.where(G.in_band(F.col("angle"), lo, hi))


def longer_than(polylines: DataFrame, least: float) -> DataFrame:
    """Polylines of a path length of ``least`` or more, longest first (P4), with ``length``."""
    return polylines.withColumn("length", G.path_length(F.col("vertices"), F.col("closed"))).where(F.col("length") >= least).orderBy(F.desc("length"), "id")


def text_matches(text: Column, pattern: str) -> Column:
    """Case-insensitive regex, or a literal where the pattern is no regex (P5)."""
    try:
        re.compile(pattern)
    except re.error:
        return F.contains(F.lower(text), F.lit(pattern.lower()))
    return text.rlike("(?i)" + pattern)


def lookup(entities: DataFrame, ids: list) -> DataFrame:
    """Rows of exact ids in the order of the list, repeats included."""
    spark = entities.sparkSession
    want = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], f"id {entities.schema['id'].dataType.simpleString()}, place int")
    return entities.join(F.broadcast(want), "id").orderBy("place")


def ends(segments: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Both ends of every segment: ``keys, id, which, rx, ry`` and the other end ``ox, oy``."""
    a = F.struct(F.lit(0).alias("which"), F.col("ax").alias("rx"), F.col("ay").alias("ry"), F.col("ex").alias("ox"), F.col("ey").alias("oy"))
    b = F.struct(F.lit(1).alias("which"), F.col("ex").alias("rx"), F.col("ey").alias("ry"), F.col("ax").alias("ox"), F.col("ay").alias("oy"))
    return segments.select(*keys, "id", F.inline(F.array(a, b)))


def nearest_to(segments: DataFrame, x: float, y: float, k: int = 1) -> DataFrame:
    """The ``k`` segments nearest a point by their real geometry (J2, O1), with ``dist``."""
    d = G.point_segment(F.lit(float(x)), F.lit(float(y)), *map(F.col, ("ax", "ay", "ex", "ey")))
    return segments.withColumn("dist", d).orderBy("dist", "id").limit(max(1, k))


def counts(entities: DataFrame, by: str) -> DataFrame:
    """Tallies and extent by kind or layer; a null layer has a key of its own (A1, A2)."""
    key = F.coalesce(F.col(by).cast("string"), F.lit("(none)")).alias("key")
    return entities.groupBy(key).agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def ground_surface(entities: DataFrame) -> DataFrame:
    """The entity of the widest extent, ties to the upper one."""
    width, mid = F.col("x1") - F.col("x0"), (F.col("y0") + F.col("y1")) / 2
    return entities.agg(F.max_by(F.struct("id", width.alias("width"), mid.alias("mid_y")), F.struct(width.alias("w"), mid.alias("m"), (-F.col("id")).alias("i"))).alias("g")).select("g.*").where("id is not null")
