"""Units, numbers, scale ratios and quantities that carry their confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of lengths, and physical lengths in metres.  Points and
# pixels are no physical lengths until a scale is applied.
SPELLINGS = {
    "pt": ["pt", "pts", "point", "points"],
    "px": ["px", "pixel", "pixels"],
    "in": ["in", "inch", "inches", '"'],
    "ft": ["ft", "foot", "feet", "'"],
    "yd": ["yd", "yard", "yards"],
    "mm": ["mm", "millimetre", "millimeter"],
    "cm": ["cm", "centimetre", "centimeter"],
    "m": ["m", "metre", "meter", "metres", "meters"],
    "km": ["km", "kilometre", "kilometer"],
    "mi": ["mi", "mile", "miles"],
}
METRES = {"in": 0.0254, "ft": 0.3048, "yd": 0.9144, "mm": 0.001, "cm": 0.01, "m": 1.0, "km": 1000.0, "mi": 1609.344}
NUMBER = r"(?:[0-9]+\s+[0-9]+\s*/\s*[0-9]+|[0-9]+\s*/\s*[0-9]+|[0-9]*\.[0-9]+|[0-9]+)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _lookup(table: dict[str, float | str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def normal_unit(unit: Column) -> Column:
    """Canonical spelling; unknown units pass unchanged."""
    table = {s: u for u, spelled in SPELLINGS.items() for s in spelled}
    return F.coalesce(_lookup(table)[F.lower(F.trim(unit))], F.trim(unit))


def convert_length(value: Column, frm: Column, to: Column) -> Column:
    """Between physical lengths; the same unit passes, anything else is null."""
    a, b = normal_unit(frm), normal_unit(to)
    m = _lookup(METRES)
    return F.when(a == b, value).otherwise(value * m[a] / m[b])


def parse_number(text: Column) -> Column:
    """``3/32``, ``1 1/2``, ``20``, ``.5``, ``1e3`` as a double, else null; a zero denominator is null."""
    mixed, frac = r"^([0-9]+) ([0-9]+) ?/ ?([0-9]+)$", r"^([0-9]+) ?/ ?([0-9]+)$"

    def parsed(t: Column) -> Column:
        def g(p: str, i: int) -> Column:
            return F.nullif(F.regexp_extract(t, p, i), F.lit("")).try_cast("double")

        plain = F.when(t.rlike(r"^[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$"), t.try_cast("double"))
        return F.when(t.rlike(mixed), g(mixed, 1) + F.try_divide(g(mixed, 2), g(mixed, 3))).when(t.rlike(frac), F.try_divide(g(frac, 1), g(frac, 2))).otherwise(plain)

    return let(F.trim(F.regexp_replace(text, r"\s+", " ")), parsed)


def _side(text: Column) -> Column:
    """One side of a ratio: ``struct(value, unit)``; feet and inches are one value in feet."""
    both = rf"^({NUMBER})\s*(?:'|ft\.?|feet|foot)\s*-?\s*({NUMBER})\s*(?:\"|in\.?|inch|inches)$"
    one = rf"^({NUMBER})\s*([A-Za-z]+|'|\")?\.?$"

    def parsed(t: Column) -> Column:
        feet = parse_number(F.regexp_extract(t, both, 1)) + parse_number(F.regexp_extract(t, both, 2)) / 12
        unit = F.regexp_extract(t, one, 2)
        whole = F.struct(feet.alias("value"), F.lit("ft").alias("unit"))
        plain = F.struct(parse_number(F.regexp_extract(t, one, 1)).alias("value"), F.when(unit != "", normal_unit(unit)).alias("unit"))
        return F.when(t.rlike(both), whole).when(t.rlike(one), plain)

    return let(F.trim(text), parsed)


def parse_ratio(text: Column) -> Column:
    """``1 in = 20 ft``, ``1/8" = 1'-0"``, ``1:100``, after an optional SCALE label.

    ``struct(page_len, page_unit, real_len, real_unit)``, null for anything else; a
    bare ratio has no units.
    """
    none = F.lit(None).cast("string")
    bare = rf"^({NUMBER})\s*:\s*({NUMBER})$"

    def stated(a: Column, b: Column) -> Column:
        got = F.struct(a["value"].alias("page_len"), a["unit"].alias("page_unit"), b["value"].alias("real_len"), b["unit"].alias("real_unit"))
        return F.when((a["value"] > 0) & (b["value"] > 0), got)

    def parsed(t: Column) -> Column:
        left = F.regexp_replace(F.substring_index(t, "=", 1), r"(?<![0-9./-])([0-9]+)-([0-9]+\s*/\s*[0-9]+)", "$1 $2")
        right = F.substring(t, F.instr(t, "=") + 1, F.length(t))
        sides = let(_side(left), lambda a: let(_side(right), lambda b: stated(a, b)))
        p, r = parse_number(F.regexp_extract(t, bare, 1)), parse_number(F.regexp_extract(t, bare, 2))
        ratio = F.struct(p.alias("page_len"), none.alias("page_unit"), r.alias("real_len"), none.alias("real_unit"))
        return F.when(F.contains(t, F.lit("=")), sides).when(t.rlike(bare) & (p > 0) & (r > 0), ratio)

    return let(F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"(?i)^scale *[:=]? *", "")), parsed)


def magnification(ratio: Column) -> Column:
    """Real lengths to one on paper, null where one side alone has a unit."""
    same = ratio["page_unit"].isNull() & ratio["real_unit"].isNull()
    real = F.when(same, ratio["real_len"]).otherwise(convert_length(ratio["real_len"], ratio["real_unit"], ratio["page_unit"]))
    return F.try_divide(real, ratio["page_len"])


def quantity(value: Column, units: Column, confidence: Column | float = 1.0, rel: Column | float = 0.0) -> Column:
    """A value with its units, confidence and relative uncertainty (G1)."""
    c = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    r = rel if isinstance(rel, Column) else F.lit(float(rel))
    return F.struct(value.cast("double").alias("value"), units.alias("units"), c.alias("confidence"), r.alias("rel_uncertainty"))


def combine_confidence(*parts: Column) -> Column:
    """The weakest of the parts that are there, clamped to [0, 1]; 0 with none."""
    least = F.least(*parts, F.lit(None).cast("double"))
    return F.when(least.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), least)))


def combine_uncertainty(*parts: Column) -> Column:
    """Root of the sum of squares of the positive parts."""
    total = F.lit(0.0)
    for p in parts:
        total = total + F.when(p > 0, p * p).otherwise(0.0)
    return F.sqrt(total)


def scaled(q: Column, factor: Column, units: Column, confidence: Column, rel: Column) -> Column:
    """The one way a quantity changes its unit system; a zero factor is an error."""
    ok = F.when(factor == 0, F.raise_error(F.lit("a non-zero scale is needed"))).otherwise(factor)
    return quantity(q["value"] * ok.cast("double"), units, combine_confidence(q["confidence"], confidence), combine_uncertainty(q["rel_uncertainty"], rel))
