"""Column functions: sample arithmetic, signed codes, quality scales, byte and path formats."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once. A column that is only named inside a lambda may be put in its place by the
    optimizer, and then it is computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def div(a: Column, b: int) -> Column:
    """Integer division that truncates, as `div` does."""
    return F.call_function("div", a, F.lit(b))


def fold_sign(v: Column) -> Column:
    """0, -1, 1, -2, 2 ... to 0, 1, 2, 3, 4 ..."""
    return F.when(v >= 0, v * 2).otherwise(v * -2 - 1)


def unfold_sign(u: Column) -> Column:
    return F.when(u % 2 == 0, div(u, 2)).otherwise(-div(u + 1, 2))


def bit_length(n: Column) -> Column:
    """Binary digits of a non-negative integer; 0 for 0."""
    return F.when(n == 0, F.lit(0)).otherwise(F.length(F.bin(n)))


def varint_bytes(n: Column) -> Column:
    """Length of a seven-bits-a-byte integer."""
    return F.greatest(F.lit(1), F.ceil(bit_length(n) / 7)).cast("int")


def size_header_bits(n: Column) -> Column:
    """Bits of a dimension in a header: 8 up to 256, else a two-bit class and 9, 13, 18 or 30 bits."""
    m = n - 1
    return F.when(n <= 256, 8).when(m < 1 << 9, 11).when(m < 1 << 13, 15).when(m < 1 << 18, 20).otherwise(32)


def distance_of_quality(q: Column) -> Column:
    return F.when(q >= 100, 0.0).when(q >= 30, 0.1 + (100 - q) / 10.0).otherwise(7.0 + (30 - q) / 3.75)


def normalise_sample(v: Column, kind: Column) -> Column:
    """Samples to 0..1, signed ones to -1..1 with the negative side's own range."""
    return F.when(kind == "uint8", v / 255.0).when(kind == "uint16", v / 65535.0).when(kind == "int16",
        F.when(v >= 0, v / 32767.0).otherwise(v / 32768.0)).otherwise(v)


def store_sample(v: Column, kind: str) -> Column:
    """0..1 (or -1..1) back to the sample's range: clamped, then truncated."""
    if kind == "uint8":
        return clamp(v * 255.0, 0.0, 255.0).cast("int")
    if kind == "uint16":
        return clamp(v * 65535.0, 0.0, 65535.0).cast("int")
    if kind == "int16":
        return clamp(v * 32767.0, -32768.0, 32767.0).cast("int")
    return v


def reinterpret_int16(v: Column) -> Column:
    return F.when(v >= 32768, v - 65536).otherwise(v)


def roi_multiplier(px: Column, py: Column, x: int, y: int, w: int, h: int, boost: float, feather: int) -> Column:
    """Distance multiplier of a region of interest: the boost inside, 1 outside, a cosine between over `feather` pixels."""
    inside = 1.0 / (1.0 + boost / 100.0)
    dx = F.when(px < x, F.lit(x) - px).when(px >= x + w, px - (x + w - 1)).otherwise(0)
    dy = F.when(py < y, F.lit(y) - py).when(py >= y + h, py - (y + h - 1)).otherwise(0)
    d = F.sqrt((dx * dx + dy * dy).cast("double"))
    t = F.least(F.lit(1.0), d / float(max(feather, 1)))
    smooth = (1 - F.cos(t * 3.141592653589793)) / 2
    out = (px < x - feather) | (px >= x + w + feather) | (py < y - feather) | (py >= y + h + feather)
    return F.when(out, 1.0).when((dx == 0) & (dy == 0), inside).otherwise(inside + (1.0 - inside) * smooth)


def byte_size(n: Column) -> Column:
    """Bytes, KB or MB with one decimal, truncated: integer arithmetic, so that all engines agree."""
    tenths = lambda unit: F.concat(div(div(n * 10, unit), 10).cast("string"), F.lit("."), (div(n * 10, unit) % 10).cast("string"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20,
        F.concat(tenths(1024), F.lit(" KB"))).otherwise(F.concat(tenths(1 << 20), F.lit(" MB")))


FORMATS = {"png": "png", "tif": "tiff", "tiff": "tiff", "bmp": "bmp"}


def format_of_extension(ext: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(F.lower(ext) == kv[0], kv[1]), FORMATS.items(), F.when(F.lit(False), F.lit("")))


def output_path(path: Column, source: str, target: str, ext: str) -> Column:
    """The path below `source` moved below `target`, with another extension."""
    return F.concat(F.lit(target.rstrip("/") + "/"), F.regexp_replace(F.substring(path, len(source.rstrip("/")) + 2, 1 << 20), r"\.[^./]*$", ""),
        F.lit("." + ext))


def json_escape(s: Column) -> Column:
    out = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    for raw, code in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def html_escape(s: Column) -> Column:
    out = s
    for raw, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out
