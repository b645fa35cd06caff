"""Image budgets and tiles as expressions; hashes, matching and ink components over small grey grids.

Grids are rows ``(height, width, pixels binary)``.  Pixel work is numpy, handed over by
Arrow; everything a page map needs afterwards is an expression again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_SIDE, CONTRAST, CONFIDENT = 16, 8, 8
FINE_TOLERANCE = 16
THRESHOLD, MERGE, WEAKER = 0.55, 0.33, 0.2
#: Sizes of an example that are looked for: half to about double in 12 % steps, of at least so many pixels a side.
SCALES, LEAST_SIDE = tuple(round(0.5 * 1.12**i, 3) for i in range(13)), 5


def fit_size(width: Column, height: Column, max_edge: Column, short_side: Column, unit: Column, max_units: Column) -> Column:
    """``struct(w, h)``: the largest whole size of an aspect that a budget fits.

    A budget limits the longer edge, the shorter edge (or null), and the patches of
    ``unit`` pixels (or null), which round up, so sizes just under the area's estimate
    are tried from above.
    """
    long, short = F.greatest(width, height), F.least(width, height)
    scale = F.least(max_edge / long, short_side / short, F.sqrt(max_units * unit * unit / (width * height)))
    top = (F.ceil(long * scale) + 1).cast("int")

    def other(n: Column) -> Column:
        return F.greatest(F.lit(1), F.floor(n * short / long)).cast("int")

    def fits(n: Column) -> Column:
        m = other(n)
        patches = F.ceil(n / unit) * F.ceil(m / unit)
        return (n <= max_edge) & F.coalesce(m <= short_side, F.lit(True)) & F.coalesce(patches <= max_units, F.lit(True))

    # a row or a column of patches over is at most two units of pixels
    first = F.greatest(F.lit(1), top - F.coalesce(unit * 2, F.lit(4)).cast("int") - 4)
    best = F.coalesce(F.array_max(F.filter(F.sequence(first, top), fits)), F.array_max(F.filter(F.sequence(F.lit(1), first), fits)), F.lit(1))
    wide = width >= height
    return F.struct(F.when(wide, best).otherwise(other(best)).alias("w"), F.when(wide, other(best)).otherwise(best).alias("h"))


def legible_window(text_pt: Column, side_px: Column, min_px: float = 14.0) -> Column:
    """The side, in points, of the largest square in which lettering still arrives tall enough."""
    return F.when(text_pt > 0, side_px * text_pt / min_px)


def tiles_per_side(text_px: Column, legible: float = 12.0, target: float = 16.0, most: int = 6) -> Column:
    n = F.ceil(target / F.greatest(text_px, F.lit(0.1))).cast("int")
    return F.when(text_px >= legible, 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(most), n)))


def tile_boxes(x0: Column, y0: Column, x1: Column, y1: Column, n: Column, overlap: float = 0.08) -> Column:
    """``n`` by ``n`` boxes, row by row, each widened so that nothing on a seam is cut."""
    w, h = (x1 - x0) / n, (y1 - y0) / n

    def box(k: Column) -> Column:
        r, c = F.floor(k / n), k % n
        return F.struct(F.greatest(x0, x0 + c * w - overlap * w).alias("x0"), F.greatest(y0, y0 + r * h - overlap * h).alias("y0"), F.least(x1, x0 + (c + 1) * w + overlap * w).alias("x1"), F.least(y1, y0 + (r + 1) * h + overlap * h).alias("y1"))

    return F.transform(F.sequence(F.lit(0), n * n - 1), box)


def image_box_to_page(box: Column, clip: Column, width_px: Column, height_px: Column) -> Column:
    """A box in the pixels of a render back on the page."""
    sx, sy = (clip["x1"] - clip["x0"]) / width_px, (clip["y1"] - clip["y0"]) / height_px
    return F.struct((clip["x0"] + box["x0"] * sx).alias("x0"), (clip["y0"] + box["y0"] * sy).alias("y0"), (clip["x0"] + box["x1"] * sx).alias("x1"), (clip["y0"] + box["y1"] * sy).alias("y1"))


def grid_of(height: int, width: int, pixels: bytes) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape(height, width)


def shrunk(grid: np.ndarray, height: int, width: int) -> np.ndarray:
    """Box means on a smaller grid."""
    r = np.linspace(0, grid.shape[0], height + 1).astype(int)
    c = np.linspace(0, grid.shape[1], width + 1).astype(int)
    total = np.zeros((grid.shape[0] + 1, grid.shape[1] + 1))
    total[1:, 1:] = grid.cumsum(0).cumsum(1)
    area = np.maximum(np.diff(r)[:, None] * np.diff(c)[None, :], 1)
    return (total[r[1:]][:, c[1:]] - total[r[:-1]][:, c[1:]] - total[r[1:]][:, c[:-1]] + total[r[:-1]][:, c[:-1]]) / area


def difference_hash(grid: np.ndarray, side: int = HASH_SIDE, guard: bool = True) -> str | None:
    """Bits of rising grey between neighbours, in hex; None for a page with too little picture."""
    g = shrunk(grid, side, side + 1)
    step = np.diff(g, axis=1)
    if guard and int((np.abs(step) > CONTRAST).sum()) < CONFIDENT:
        return None
    return np.packbits((step > 0).ravel()).tobytes().hex()


def same_picture(a: np.ndarray | None, b: np.ndarray | None) -> bool:
    return a is not None and b is not None and a.shape == b.shape and int(np.abs(a.astype(int) - b.astype(int)).max(initial=0)) <= FINE_TOLERANCE


def hashes(grids: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, hash`` of grids, null where there is too little picture."""
    types = {f.name: f.dataType.simpleString() for f in grids.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["hash"] = [difference_hash(grid_of(h, w, p)) for h, w, p in zip(b["height"], b["width"], b["pixels"])]
            yield b[[*keys, "hash"]]

    return grids.select(*keys, "height", "width", "pixels").mapInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", hash string")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hex strings of equal length, else null."""
    ok = F.length(a) == F.length(b)
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(a) / 8).cast("int") - 1, F.lit(0)))

    def word(h: Column, i: Column) -> Column:
        return F.conv(F.substring(h, i * 8 + 1, F.lit(8)), 16, 10).cast("long")

    return F.when(ok, F.aggregate(parts, F.lit(0), lambda n, i: n + F.bit_count(word(a, i).bitwiseXOR(word(b, i)))))


def correlation(image: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Normalised cross-correlation at every place the template fits, by one Fourier transform."""
    t = template.astype(float) - template.mean()
    norm = np.sqrt((t**2).sum())
    h, w = template.shape
    if norm == 0 or image.shape[0] < h or image.shape[1] < w:
        return np.zeros((max(image.shape[0] - h + 1, 0), max(image.shape[1] - w + 1, 0)))
    size = [image.shape[0] + h - 1, image.shape[1] + w - 1]
    cross = np.fft.irfft2(np.fft.rfft2(image.astype(float), size) * np.fft.rfft2(t[::-1, ::-1], size), size)[h - 1 : image.shape[0], w - 1 : image.shape[1]]
    s = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    q = np.zeros_like(s)
    s[1:, 1:] = image.astype(float).cumsum(0).cumsum(1)
    q[1:, 1:] = (image.astype(float) ** 2).cumsum(0).cumsum(1)
    box = lambda a: a[h:, w:] - a[:-h, w:] - a[h:, :-w] + a[:-h, :-w]
    var = np.maximum(box(q) - box(s) ** 2 / (h * w), 0)
    return np.where(var > 1e-9, cross / (np.sqrt(var) * norm + 1e-12), 0)


def _taps(n: int, scale: float) -> np.ndarray:
    """Weights of ``n`` samples for every resized one: area means to shrink, linear between centres to enlarge."""
    m = max(1, round(n * scale))
    at = np.arange(n)
    if scale < 1:
        lo, hi = np.arange(m)[:, None] / scale, np.minimum((np.arange(m)[:, None] + 1) / scale, n)
        w = np.maximum(np.minimum(hi, at + 1) - np.maximum(lo, at), 0)
    else:
        w = np.maximum(1 - np.abs(np.clip((np.arange(m)[:, None] + 0.5) / scale - 0.5, 0, n - 1) - at), 0)
    return w / w.sum(1, keepdims=True)


def scaled(grid: np.ndarray, scale: float) -> np.ndarray:
    return _taps(grid.shape[0], scale) @ grid @ _taps(grid.shape[1], scale).T if scale != 1 else grid.astype(float)


def find_like(grids: DataFrame, keys: list[str], template: np.ndarray, scales: tuple[float, ...] = SCALES, turns: tuple[int, ...] = (0, 90, 180, 270), threshold: float = THRESHOLD, most: int = 400) -> DataFrame:
    """``keys, x0, y0, x1, y1, score, turn, scale`` of places like a template (X24), best first and without overlaps."""
    types = {f.name: f.dataType.simpleString() for f in grids.schema.fields}
    names = [*keys, "x0", "y0", "x1", "y1", "score", "turn", "scale"]
    looks = [(s, r, np.rot90(t, r // 90)) for s in scales for t in [scaled(template, s)] if min(t.shape) >= LEAST_SIDE for r in turns]

    def found(image: np.ndarray) -> list[tuple]:
        hits = []
        for s, r, t in looks:
            score = correlation(image, t)
            for y, x in np.argwhere(score >= threshold):
                hits.append((float(score[y, x]), int(x), int(y), int(x + t.shape[1]), int(y + t.shape[0]), r, s))
        hits.sort(key=lambda h: (-h[0], h[2], h[1], h[5]))
        kept: list[tuple] = []
        for h in hits:
            clash = False
            for k in kept:
                w, d = min(h[3], k[3]) - max(h[1], k[1]), min(h[4], k[4]) - max(h[2], k[2])
                if w > 0 and d > 0 and (w * d / min((h[3] - h[1]) * (h[4] - h[2]), (k[3] - k[1]) * (k[4] - k[2])) >= MERGE or k[0] - h[0] > WEAKER):
                    clash = True
                    break
            if not clash:
                kept.append(h)
            if len(kept) >= most:
                break
        return kept

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*(getattr(r, k) for k in keys), *h[1:5], round(h[0], 6), h[5], h[6]) for r in b.itertuples() for h in found(grid_of(r.height, r.width, r.pixels))]
            yield pd.DataFrame(rows, columns=names)

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", x0 int, y0 int, x1 int, y1 int, score double, turn int, scale double"
    return grids.select(*keys, "height", "width", "pixels").mapInPandas(run, schema)


def components(mask: np.ndarray, least: int = 4) -> list[tuple[int, int, int, int, int]]:
    """Eight-connected ink, ``(x0, y0, x1, y1, pixels)`` by runs and union-find."""
    runs, parent, before = [], [], []
    for y, row in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.r_[0, row.astype(np.int8), 0]))
        here = []
        for a, b in zip(edge[::2], edge[1::2]):
            i = len(runs)
            runs.append((y, a, b))
            parent.append(i)
            for j in before:
                if runs[j][1] <= b and runs[j][2] >= a:
                    ri, rj = i, j
                    while parent[ri] != ri:
                        ri = parent[ri]
                    while parent[rj] != rj:
                        rj = parent[rj]
                    parent[max(ri, rj)] = min(ri, rj)
            here.append(i)
        before = here
    blobs: dict[int, list[int]] = {}
    for i, (y, a, b) in enumerate(runs):
        r = i
        while parent[r] != r:
            r = parent[r]
        box = blobs.setdefault(r, [a, y, b, y + 1, 0])
        box[0], box[1], box[2], box[3], box[4] = min(box[0], a), min(box[1], y), max(box[2], b), max(box[3], y + 1), box[4] + (b - a)
    return [tuple(int(v) for v in b) for b in blobs.values() if b[4] >= least]


def drawn_lines(mask: np.ndarray, least: int, gap: int = 2) -> list[tuple[str, int, int, int]]:
    """Horizontal and vertical rules ``(orientation, at, from, to)`` whose pieces, joined over gaps, are long enough."""
    out = []
    for name, m in (("h", mask), ("v", mask.T)):
        for at, row in enumerate(m):
            edge = np.flatnonzero(np.diff(np.r_[0, row.astype(np.int8), 0]))
            pieces: list[list[int]] = []
            for a, b in zip(edge[::2], edge[1::2]):
                if pieces and a - pieces[-1][1] <= gap:
                    pieces[-1][1] = int(b)
                else:
                    pieces.append([int(a), int(b)])
            out += [(name, at, a, b) for a, b in pieces if b - a >= least]
    return out
