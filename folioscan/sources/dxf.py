"""ASCII DXF files as entities, read by a Python data source.

``spark.dataSource.register(DxfSource)``, then ``spark.read.format("dxf").load(paths)``: one
partition for each file named in ``paths`` (comma separated).  For files in a store that
only Spark reads, use `entities_of_files` over the ``binaryFile`` source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Fixed values: $INSUNITS codes with a length.
UNITS = {1: "in", 2: "ft", 4: "mm", 5: "cm", 6: "m"}
SCHEMA = "doc_key string, space string, id string, ord int, kind string, layer string, color int, x0 double, y0 double, x1 double, y1 double, xs array<double>, ys array<double>, closed boolean, radius double, start_angle double, end_angle double, content string, height double, rotation double, units string"
_KINDS = {"LINE": "line", "LWPOLYLINE": "polyline", "POLYLINE": "polyline", "ARC": "arc", "CIRCLE": "circle", "TEXT": "text", "MTEXT": "text", "LEADER": "leader", "DIMENSION": "dimension", "POINT": "point"}


def tags(text: str) -> Iterator[tuple[int, str]]:
    """Group codes and values; a file that ends between the two ends there."""
    lines = text.splitlines()
    for i in range(0, len(lines) - 1, 2):
        try:
            yield int(lines[i]), lines[i + 1].strip("\r\n")
        except ValueError:
            return


def _number(v: str) -> float:
    try:
        return float(v)
    except ValueError:
        return math.nan


def minsert(x: float, y: float, columns: int, rows: int, dx: float, dy: float, degrees: float) -> list[tuple[float, float]]:
    """Insertion points of every cell of a grid insert, in the insert's own rotated frame."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return [(x + i * dx * c - j * dy * s, y + i * dx * s + j * dy * c) for j in range(max(rows, 1)) for i in range(max(columns, 1))]


class _Reading:
    """Entities of one file; inserts are replaced by the entities of their block."""

    def __init__(self, text: str) -> None:
        self.blocks: dict[str, tuple[tuple[float, float], list]] = {}
        self.entities: list[tuple[str, list[tuple[int, str]]]] = []
        self.units = None
        section, block, current, variable = None, None, None, None
        for code, value in tags(text):
            if code == 0:
                current = None
                if value == "SECTION":
                    section = ""
                elif value == "ENDSEC":
                    section = None
                elif section == "BLOCKS" and value == "BLOCK":
                    block = [None, [0.0, 0.0], []]
                elif value == "ENDBLK" and block:
                    self.blocks[block[0] or ""] = (tuple(block[1]), block[2])
                    block = None
                elif section == "ENTITIES" or (section == "BLOCKS" and block):
                    current = (value, [])
                    (block[2] if block else self.entities).append(current)
                continue
            if section == "" and code == 2:
                section = value
            elif section == "HEADER":
                variable = value if code == 9 else variable
                if variable == "$INSUNITS" and code == 70:
                    self.units = UNITS.get(int(_number(value)) if value.strip().lstrip("-").isdigit() else 0)
            elif current is not None:
                current[1].append((code, value))
            elif block is not None and code in (2, 10, 20):
                if code == 2:
                    block[0] = block[0] or value
                else:
                    block[1][code // 10 - 1] = _number(value)

    def rows(self) -> Iterator[tuple]:
        n = 0
        for row in self._walk(self.entities, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), 0, ""):
            yield (*row[:2], n, *row[2:])
            n += 1

    def _walk(self, entities: list, m: tuple, depth: int, path: str) -> Iterator[tuple]:
        joined: list | None = None
        for k, (name, body) in enumerate(entities):
            first = {}
            for code, v in body:
                first.setdefault(code, v)
            num = lambda c, d=0.0, first=first: _number(first[c]) if c in first else d
            if name == "INSERT" and depth < 8:
                base, inner = self.blocks.get(first.get(2, ""), ((0.0, 0.0), []))
                sx, sy, rot = num(41, 1.0), num(42, 1.0), num(50)
                for px, py in minsert(num(10), num(20), int(num(70, 1)), int(num(71, 1)), num(44), num(45), rot):
                    c, s = math.cos(math.radians(rot)), math.sin(math.radians(rot))
                    a, b, cc, d = sx * c, -sy * s, sx * s, sy * c
                    inside = (a, b, cc, d, px - a * base[0] - b * base[1], py - cc * base[0] - d * base[1])
                    yield from self._walk(inner, _times(m, inside), depth + 1, f"{path}{first.get(5, k)}/")
            elif name == "POLYLINE":
                joined = [first, []]
            elif name == "VERTEX" and joined:
                joined[1].append((num(10), num(20)))
            elif name == "SEQEND" and joined:
                yield self._row("POLYLINE", joined[0], joined[1], m, f"{path}{joined[0].get(5, k)}")
                joined = None
            elif name in _KINDS:
                pts = list(zip([_number(v) for c, v in body if c == 10], [_number(v) for c, v in body if c == 20]))
                if name == "LINE":
                    pts.append((num(11), num(21)))
                if name == "DIMENSION":
                    pts = [(num(13), num(23)), (num(14), num(24))]
                yield self._row(name, first, pts, m, f"{path}{first.get(5, k)}")

    def _row(self, name: str, first: dict, pts: list, m: tuple, ident: str) -> tuple:
        out = [(m[0] * x + m[1] * y + m[4], m[2] * x + m[3] * y + m[5]) for x, y in pts]
        radius = _number(first[40]) * math.hypot(m[0], m[2]) if name in ("ARC", "CIRCLE") and 40 in first else None
        xs, ys = [p[0] for p in out], [p[1] for p in out]
        box = (None, None, None, None) if not out else (min(xs) - (radius or 0), min(ys) - (radius or 0), max(xs) + (radius or 0), max(ys) + (radius or 0))
        turn = math.degrees(math.atan2(m[2], m[0]))
        text = first.get(1) if name in ("TEXT", "MTEXT", "DIMENSION") else None
        return (
            "paper" if first.get(67, "0").strip() == "1" else "model", ident, _KINDS[name], first.get(8), int(_number(first[62])) if 62 in first else None, *box, xs, ys,
            name in ("LWPOLYLINE", "POLYLINE") and int(_number(first.get(70, "0"))) & 1 == 1, radius, _number(first[50]) + turn if name == "ARC" and 50 in first else None, _number(first[51]) + turn if name == "ARC" and 51 in first else None,
            text, _number(first[40]) if text is not None and 40 in first else None, (_number(first[50]) if 50 in first else 0.0) + turn if name in ("TEXT", "MTEXT") else None, self.units,
        )


def _times(m: tuple, n: tuple) -> tuple:
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[0] * n[4] + m[1] * n[5] + m[4], m[2] * n[4] + m[3] * n[5] + m[5])


def parse(text: str, doc_key: str) -> list[tuple]:
    """Rows of ``SCHEMA`` of one file's text."""
    return [(doc_key, *row) for row in _Reading(text).rows()]


class DxfSource(DataSource):
    """ASCII DXF as a batch source."""

    @classmethod
    def name(cls) -> str:
        return "dxf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"].split(","))


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, encoding="utf-8", errors="replace") as f:
            yield from parse(f.read(), partition.value)


def entities_of_files(files: DataFrame) -> DataFrame:
    """Entities of the rows ``(path, content)`` of the ``binaryFile`` source; a file without entities gives none."""

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, body in zip(b.column(0), b.column(1)):
                rows = parse((body.as_py() or b"").decode("utf-8", "replace"), path.as_py())
                cols = list(zip(*rows)) or [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)

    return files.select(F.col("path"), F.col("content")).mapInArrow(run, SCHEMA)
