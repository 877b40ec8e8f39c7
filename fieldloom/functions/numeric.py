"""Numbers, boxes, vectors and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the 32-bit FNV-1a hash.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619


def clamp01(x: Column) -> Column:
    """Into [0, 1]; null, NaN and infinities are 0."""
    x = x.cast("double")
    odd = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(odd, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def quantise(x: Column, digits: int = 6) -> Column:
    """``x`` to ``digits`` decimals by its exact binary value, ties away from zero: 0.3255 lies below the tie and becomes 0.325.

    The product with 10 ** digits is a double and its exact error (Veltkamp's split and Dekker's product), so the distance to the tie has the right sign. Null and
    numbers that are not finite stay, and so do those with no place for that many decimals.
    """
    if not 0 <= digits <= 11:
        raise ValueError("a power of ten of more than 26 significant bits would not split exactly")
    power = float(10**digits)
    size = F.abs(x.cast("double"))
    carried = size * 134217729.0
    high = carried - (carried - size)
    product = size * power
    error = (high * power - product) + (size - high) * power
    whole = F.floor(product).cast("double")
    over = product - whole
    up = (over > 0.5) | ((over == 0.5) & (error >= 0))
    found = (whole + F.when(up, 1.0).otherwise(0.0)) / power * F.signum(x.cast("double"))
    return F.when(F.isnan(x) | (product >= float(1 << 53)), x.cast("double")).otherwise(found)


def falsy(x: Column, other: Column) -> Column:
    """``x``, but ``other`` where it is null or zero."""
    return F.coalesce(F.nullif(x, F.lit(0.0)), other)


def code_units(text: Column) -> Column:
    """The UTF-16 code units of a text: a character beyond U+FFFF has two. Null is empty.

    The bytes are bound by a lambda: an expression inside one is found anew for each item, and so is a place in a string, which would cost the square of a long text.
    """
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-16BE")
    unit = lambda b, k: F.conv(F.hex(F.substring(b, k, F.lit(2))), 16, 10).cast("long")
    return F.flatten(F.transform(F.filter(F.array(raw), lambda b: F.length(b) > 0), lambda b: F.transform(F.sequence(F.lit(1), F.length(b) - 1, F.lit(2)), lambda k: unit(b, k))))


def fnv1a(text: Column) -> Column:
    """Eight hex digits of the FNV-1a hash over UTF-16 code units."""
    return fnv1a_units(code_units(text))


def fnv1a_units(units: Column) -> Column:
    """``fnv1a`` of a text whose code units are known."""
    mixed = F.aggregate(units, F.lit(FNV_BASIS).cast("long"), lambda h, c: h.bitwiseXOR(c) * F.lit(FNV_PRIME) % F.lit(1 << 32))
    return F.lower(F.lpad(F.hex(mixed), 8, "0"))


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (width, "width"), (height, "height"))])


def bounds(points: Column) -> Column:
    """The box around an array of (x, y) points."""
    low = lambda k: F.array_min(F.transform(points, lambda p: p[k]))
    high = lambda k: F.array_max(F.transform(points, lambda p: p[k]))
    return box(low("x"), low("y"), high("x") - low("x"), high("y") - low("y"))


def shared_area(a: Column, b: Column) -> Column:
    side = lambda p, s: F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p])
    return F.greatest(F.lit(0.0), side("x", "width")) * F.greatest(F.lit(0.0), side("y", "height"))


def area(a: Column) -> Column:
    return a["width"] * a["height"]


def iou(a: Column, b: Column) -> Column:
    both = shared_area(a, b)
    union = area(a) + area(b) - both
    return F.when(union <= 0, 0.0).otherwise(both / union)


def covered(a: Column, b: Column) -> Column:
    """Shared area over the smaller area."""
    smaller = F.least(area(a), area(b))
    return F.when(smaller <= 0, 0.0).otherwise(shared_area(a, b) / smaller)


def centre_distance(a: Column, b: Column) -> Column:
    gap = lambda p, s: (a[p] + a[s] / 2) - (b[p] + b[s] / 2)
    return F.sqrt(gap("x", "width") * gap("x", "width") + gap("y", "height") * gap("y", "height"))


def to_pixels(value: Column, unit: Column) -> Column:
    """Inches at 96 to the inch; other units as they are."""
    return F.when(unit == "inch", value * 96).otherwise(value)


def box_to_1000(a: Column, width: Column, height: Column) -> Column:
    """left, top, right, bottom on a page of 1000 by 1000."""
    scale = lambda v, full: F.greatest(F.lit(0), F.least(F.lit(1000), F.floor(v / full * 1000 + 0.5))).cast("int")
    return F.array(scale(a["x"], width), scale(a["y"], height), scale(a["x"] + a["width"], width), scale(a["y"] + a["height"], height))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Signed cosine; 0 for a zero vector."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def cosine01(a: Column, b: Column) -> Column:
    """Cosine between 0 and 1; 0 for a zero vector and for vectors of different lengths."""
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(clamp01(cosine(a, b)))


def unit_vector(a: Column) -> Column:
    size = F.sqrt(dot(a, a))
    return F.when(size == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / size))


def blend(*parts: tuple[float, Column]) -> Column:
    """A weighted sum whose weights are brought to a total of one."""
    total = max(1e-6, sum(w for w, _ in parts))
    out = F.lit(0.0)
    for weight, value in parts:
        out = out + F.lit(weight / total) * value
    return out
