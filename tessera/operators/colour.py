"""Colour transforms over (image_id, c, y, x, v): channels to columns, expressions, and back to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp

#: Fixed values of the opsin model: absorbance of L, M and S, its inverse, and the bias of the cube root.
ABSORBANCE = ((0.30078125, 0.63046875, 0.06875), (0.23046875, 0.69531250, 0.07421875), (0.24218750, 0.07812500, 0.67968750))
INVERSE_ABSORBANCE = ((10.948393, -9.924701, -0.023692), (-3.252452, 4.404409, -0.151958), (-3.527307, 3.030134, 1.497173))
BIAS = 0.00379246


def to_columns(px: DataFrame, *names: str) -> DataFrame:
    """A row a pixel, a column a channel: one shuffle by pixel, combined before it."""
    return px.groupBy("image_id", "y", "x").agg(*[F.max(F.when(F.col("c") == i, F.col("v"))).alias(n) for i, n in enumerate(names)])


def to_rows(columns: DataFrame, *names: str) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(i).cast("long").alias("c"), F.col(n).alias("v")) for i, n in enumerate(names)])
    return columns.select("image_id", "y", "x", F.explode(parts).alias("p")).select("image_id", "p.c", "y", "x", "p.v")


def rct_forward(px: DataFrame) -> DataFrame:
    """Reversible luma and chroma differences in integers, without the biased 16-bit store that would clip them."""
    d = to_columns(px, "r", "g", "b").withColumn("co", F.col("r") - F.col("b"))
    d = d.withColumn("t", F.col("b") + F.shiftright("co", 1)).withColumn("cg", F.col("g") - F.col("t"))
    return to_rows(d.withColumn("yy", F.col("t") + F.shiftright("cg", 1)), "yy", "co", "cg")


def rct_inverse(px: DataFrame) -> DataFrame:
    d = to_columns(px, "yy", "co", "cg").withColumn("t", F.col("yy") - F.shiftright("cg", 1))
    d = d.withColumn("g", F.col("cg") + F.col("t")).withColumn("b", F.col("t") - F.shiftright("co", 1))
    return to_rows(d.withColumn("r", F.col("b") + F.col("co")), "r", "g", "b")


def ycbcr_forward(px: DataFrame, offset: float = 128.0) -> DataFrame:
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    d = to_columns(px, "r", "g", "b").select(
        "image_id", "y", "x", (0.299 * r + 0.587 * g + 0.114 * b).alias("luma"),
        (-0.168736 * r - 0.331264 * g + 0.5 * b + offset).alias("cb"), (0.5 * r - 0.418688 * g - 0.081312 * b + offset).alias("cr"),
    )
    return to_rows(d, "luma", "cb", "cr")


def ycbcr_inverse(px: DataFrame, offset: float = 128.0) -> DataFrame:
    luma, cb, cr = F.col("luma"), F.col("cb") - offset, F.col("cr") - offset
    d = to_columns(px, "luma", "cb", "cr").select("image_id", "y", "x", (luma + 1.402 * cr).alias("r"),
        (luma - 0.344136 * cb - 0.714136 * cr).alias("g"), (luma + 1.772 * cb).alias("b"))
    return to_rows(d, "r", "g", "b")


def ycbcr_integers(px: DataFrame) -> DataFrame:
    """Clamped to 0..255 and truncated."""
    return ycbcr_forward(px).withColumn("v", clamp(F.col("v"), 0.0, 255.0).cast("int"))


def _mix(rows: tuple, values: list[Column]) -> list[Column]:
    return [sum((F.lit(k) * v for k, v in zip(row[1:], values[1:], strict=True)), F.lit(row[0]) * values[0]) for row in rows]


def xyb_forward(px: DataFrame, peak: float = 255.0) -> DataFrame:
    """The float form; a store into unsigned samples would lose the negative X."""
    bias = BIAS ** (1 / 3)
    lms = [F.cbrt(F.greatest(F.lit(0.0), m) + BIAS) - bias for m in _mix(ABSORBANCE, [F.col(n) / peak for n in ("r", "g", "b")])]
    d = to_columns(px, "r", "g", "b").select("image_id", "y", "x", ((lms[0] - lms[1]) * 0.5).alias("xx"), ((lms[0] + lms[1]) * 0.5).alias("yy"),
        lms[2].alias("bb"))
    return to_rows(d, "xx", "yy", "bb")


def xyb_inverse(px: DataFrame, peak: float = 255.0) -> DataFrame:
    bias = BIAS ** (1 / 3)
    cube = lambda v: (v + bias) * (v + bias) * (v + bias) - BIAS
    lms = [cube(F.col("yy") + F.col("xx")), cube(F.col("yy") - F.col("xx")), cube(F.col("bb"))]
    r, g, b = (x * peak for x in _mix(INVERSE_ABSORBANCE, lms))
    return to_rows(to_columns(px, "xx", "yy", "bb").select("image_id", "y", "x", r.alias("r"), g.alias("g"), b.alias("b")), "r", "g", "b")


def opponent(px: DataFrame, peak: float = 255.0) -> DataFrame:
    """Cube roots of the channels as red-green, luminance and blue-yellow differences."""
    r, g, b = (F.pow(F.greatest(F.col(n) / peak, F.lit(0.0)), F.lit(1.0 / 3.0)) for n in ("r", "g", "b"))
    d = to_columns(px, "r", "g", "b").select("image_id", "y", "x", (r - g).alias("o0"), ((r + g) / 2).alias("o1"), (b - (r + g) / 2).alias("o2"))
    return to_rows(d, "o0", "o1", "o2")
