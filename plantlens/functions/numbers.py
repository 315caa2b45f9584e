"""Exact decimals, C formats, fixed-layout payloads and small geometry."""

from __future__ import annotations

import struct
from decimal import Context, Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def add_decimal_text(a: pd.Series, b: pd.Series) -> pd.Series:
    """Exact sum of two decimal texts, in plain notation with the larger scale; null where one isn't a number."""
    exact = Context(prec=200)

    def add(x, y):
        try:
            total = exact.add(Decimal(x.strip()), Decimal(y.strip()))
            return format(total, "f") if total.is_finite() else None
        except (InvalidOperation, AttributeError):
            return None

    return pd.Series([add(x, y) for x, y in zip(a, b)], dtype=object)


def sum_exact(a: Column, b: Column, scale: int = 2) -> Column:
    """Exact sum of two numbers of a fixed scale, for what fits into 18 digits."""
    return a.cast(f"decimal(18,{scale})") + b.cast(f"decimal(18,{scale})")


def c_format(value: float, digits: int = 6) -> str | None:
    """`%g` with exponents of three digits at least."""
    if value is None:
        return None
    if value != value:
        return "nan"
    text = format(value, f".{digits}g")
    if "e" not in text:
        return text
    mantissa, exponent = text.split("e")
    return f"{mantissa}e{exponent[0]}{exponent[1:].zfill(3)}"


@F.pandas_udf(StringType())
def format_g(value: pd.Series) -> pd.Series:
    return value.map(c_format).where(value.notna() | value.map(lambda x: isinstance(x, float)), None)


def payload_width(types: Column) -> Column:
    """Bytes of a list of schema types: 2 for I and B, 4 for R."""
    return F.aggregate(types, F.lit(0), lambda a, t: a + F.when(t == "R", 4).otherwise(2))


def decode_payload(types: list[str], payload: bytes) -> list[float | int] | None:
    """Values of a little-endian payload; null unless the types use up exactly its bytes."""
    layout = "<" + "".join("f" if t == "R" else "H" for t in types)
    return list(struct.unpack(layout, payload)) if struct.calcsize(layout) == len(payload) else None


def length_of(dx: Column, dy: Column) -> Column:
    """Length of a vector. Equal sums of squares have equal lengths, which hypot doesn't promise."""
    dx, dy = dx.cast("double"), dy.cast("double")
    return F.sqrt(dx * dx + dy * dy)


def box_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a box, 0 inside."""
    zero = F.lit(0.0)
    return length_of(F.greatest(x1 - x, zero, x - x2), F.greatest(y1 - y, zero, y - y2))


def in_box(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return x.between(x1, x2) & y.between(y1, y2)


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Struct of the distance from a segment, and whether the nearest point lies strictly inside it.

    Along an axis the nearest point is a bound or the point's own place, without the rounding of a quotient: points on such a
    segment have distance 0 exactly.
    """
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length > 0, ((x - x1) * dx + (y - y1) * dy) / length).otherwise(0.0)
    near = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    held = lambda v, a, b: F.greatest(F.least(v, F.greatest(a, b)), F.least(a, b))
    near_x = F.when(dx == 0, x1).when(dy == 0, held(x, x1, x2)).otherwise(x1 + near * dx)
    near_y = F.when(dy == 0, y1).when(dx == 0, held(y, y1, y2)).otherwise(y1 + near * dy)
    return F.struct(length_of(x - near_x, y - near_y).alias("distance"), ((t > 0) & (t < 1)).alias("interior"))


def zone(value: Column, origin: Column, pitch: Column) -> Column:
    """Two-digit bin of a coordinate, null outside 0..99."""
    bin_ = F.floor((value - origin) / pitch)
    return F.when(bin_.between(0, 99), F.lpad(bin_.cast("string"), 2, "0"))


def side_of(fx: Column, fy: Column) -> Column:
    """Side of a box that a pin at fractions fx, fy is on."""
    return F.when(fx <= 0.3, "left").when(fx >= 0.7, "right").when(fy >= 0.7, "top").when(fy <= 0.3, "bottom")


def compose(outer: Column, inner: Column) -> Column:
    """Affine transform (a, b, c, d, e, f) that applies inner, then outer: x' = a x + c y + e, y' = b x + d y + f."""
    o, i = outer, inner
    return F.struct(
        (o["a"] * i["a"] + o["c"] * i["b"]).alias("a"), (o["b"] * i["a"] + o["d"] * i["b"]).alias("b"),
        (o["a"] * i["c"] + o["c"] * i["d"]).alias("c"), (o["b"] * i["c"] + o["d"] * i["d"]).alias("d"),
        (o["a"] * i["e"] + o["c"] * i["f"] + o["e"]).alias("e"), (o["b"] * i["e"] + o["d"] * i["f"] + o["f"]).alias("f"),
    )


def transform_point(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def rotate_right(x: Column, y: Column, quarter_turns: Column) -> Column:
    """Point turned about the origin by quarter turns."""
    k = F.pmod(quarter_turns, F.lit(4))
    return F.struct(F.when(k == 0, x).when(k == 1, -y).when(k == 2, -x).otherwise(y).alias("x"), F.when(k == 0, y).when(k == 1, x).when(k == 2, -y).otherwise(-x).alias("y"))


def plot_time(ts: Column) -> Column:
    return F.date_format(ts, "hh:mm:ss a MM/dd/yyyy")


def upper_median(values: Column, empty: float) -> Column:
    """The element in the middle of the sorted array, the upper one of two; no interpolation."""
    held = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    return F.coalesce(F.try_element_at(held, (F.floor(F.size(held) / 2) + 1).cast("int")), F.lit(empty))


def pairs_of(points: Column) -> Column:
    """Segments between neighbours of a polyline."""
    return F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), lambda p, q: F.struct(p.alias("from"), q.alias("to")))
