"""Blocks: extraction, cosine transforms, quantisation, scan orders, chroma prediction, passes.

A block is a row with an array of its samples in row order: a picture's pixels are gathered once, by block. Transforms and
quantisation are matrix products over all blocks of an Arrow batch; an array expression would interpret a thousand steps a
block. What touches a sample once (scans, activity, passes) stays in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions.scalar import clamp, let

BLOCK = ["image_id", "c", "by", "bx"]

#: Sizes (width, height) of the transforms.
SIZES = ((8, 8), (16, 8), (8, 16), (16, 16), (32, 8), (8, 32), (32, 16), (16, 32), (32, 32))


def extract(px: DataFrame, bw: int = 8, bh: int = 8, width: int | None = None, height: int | None = None) -> DataFrame:
    """Blocks of bw x bh samples. With the picture's size given, blocks beyond its edges repeat the last row and column."""
    if width and height and (width % bw or height % bh):
        pad_x, pad_y = -width % bw, -height % bh
        xs = F.when(F.col("x") == width - 1, F.sequence(F.col("x"), F.col("x") + pad_x)).otherwise(F.array("x"))
        ys = F.when(F.col("y") == height - 1, F.sequence(F.col("y"), F.col("y") + pad_y)).otherwise(F.array("y"))
        px = px.withColumn("x", F.explode(xs)).withColumn("y", F.explode(ys))
    place = ((F.col("y") % bh) * bw + F.col("x") % bw).alias("i")
    cell = F.struct(place, F.col("v").cast("double").alias("v"))
    d = px.groupBy("image_id", "c", F.expr(f"y div {bh}").alias("by"),
        F.expr(f"x div {bw}").alias("bx")).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return d.select(*BLOCK, F.transform("cells", lambda s: s["v"]).alias("coef"))


def place(blocks: DataFrame, bw: int = 8, bh: int = 8, width: int | None = None, height: int | None = None) -> DataFrame:
    """Back to pixels; what lies beyond the picture is cropped."""
    d = blocks.select(*BLOCK, F.posexplode("coef").alias("i", "v"))
    d = d.select("image_id", "c", F.expr(f"by * {bh} + i div {bw}").alias("y"), F.expr(f"bx * {bw} + i % {bw}").alias("x"), "v")
    return d.where((F.col("x") < width) & (F.col("y") < height)) if width and height else d


def _basis(n: int) -> list[list[float]]:
    return [[math.sqrt((1 if k == 0 else 2) / n) * math.cos((2 * i + 1) * k * math.pi / (2 * n)) for i in range(n)] for k in range(n)]


def _each_block(blocks: DataFrame, column: str, out: str, kind: str, of: Callable[[np.ndarray, pa.RecordBatch], np.ndarray]) -> DataFrame:
    """blocks with the array column `out`: a numpy function of all blocks of an Arrow batch, a row of samples each."""
    names = [c for c in blocks.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples = batch.column(column).flatten().to_numpy(zero_copy_only=False)
            result = of(samples.reshape(len(batch), -1), batch) if len(batch) else samples
            ends = np.arange(len(batch) + 1, dtype=np.int32) * (result.shape[1] if len(batch) else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.ListArray.from_arrays(ends, result.ravel())], names=[*names, out])

    fields = [blocks.schema[c] for c in names]
    return blocks.mapInArrow(run, StructType([*fields, StructField(out, ArrayType(DoubleType() if kind == "double" else IntegerType()))]))


def _products(blocks: DataFrame, rows: np.ndarray, columns: np.ndarray) -> DataFrame:
    """Each block's rows times a matrix, then its columns: two products for all blocks of a batch."""
    w, h = len(rows), len(columns)
    return _each_block(blocks, "coef", "coef", "double", lambda s, _: (columns @ (s.reshape(-1, h, w) @ rows.T)).reshape(-1, h * w))


def dct(blocks: DataFrame, bw: int = 8, bh: int = 8) -> DataFrame:
    """Orthonormal two-dimensional DCT-II of blocks of bw x bh samples."""
    return _products(blocks, np.array(_basis(bw)), np.array(_basis(bh)))


def idct(blocks: DataFrame, bw: int = 8, bh: int = 8) -> DataFrame:
    return _products(blocks, np.array(_basis(bw)).T, np.array(_basis(bh)).T)


def matrix_multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, k, v) times (k, j, v) as an equi-join and a grouped sum."""
    d = a.select("i", "k", F.col("v").alias("p")).join(b.select("k", "j", F.col("v").alias("q")), "k")
    return d.groupBy("i", "j").agg(F.sum(F.col("p") * F.col("q")).alias("v"))


def activity(coef: Column, n: int = 64) -> Column:
    """Population variance of a block's samples, 0 at least."""
    start = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("q"))
    step = lambda a, v: F.struct((a["t"] + v).alias("t"), (a["q"] + v * v).alias("q"))
    return F.aggregate(coef, start, step, lambda a: F.greatest(F.lit(0.0), a["q"] / n - (a["t"] / n) * (a["t"] / n)))


def adaptive_scale(activity_: Column, strength: float = 1.0, kappa: float = 0.01) -> Column:
    return 1.0 + strength * (activity_ / (activity_ + kappa) - 0.5)


def quant_step(c: Column, i: Column, distance: float, scale: Column) -> Column:
    """Step of coefficient i: grows with frequency, half to twice by the block's scale, half as much again for chroma."""
    x, y = i % 8, F.call_function("div", i, F.lit(8))
    return F.lit(max(1.0, 8.0 * distance)) * (1.0 + 0.5 * (x + y)) * clamp(1.0 / scale, 0.5, 2.0) * F.when(c > 0, 1.5).otherwise(1.0)


def _steps(batch: pa.RecordBatch, distance: float, scale: str) -> np.ndarray:
    """quant_step of all 64 coefficients of each block in a batch."""
    i = np.arange(64)
    grow = max(1.0, 8.0 * distance) * (1.0 + 0.5 * (i % 8 + i // 8))
    by_scale = np.clip(1.0 / batch.column(scale).to_numpy(), 0.5, 2.0)
    return grow * by_scale[:, None] * np.where(batch.column("c").to_numpy() > 0, 1.5, 1.0)[:, None]


def quantise(blocks: DataFrame, distance: float, scale: str = "scale") -> DataFrame:
    """q: coefficients over their steps, half away from zero, clamped to 16 bits."""

    def of(coef: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        q = coef / _steps(batch, distance, scale)
        return np.clip(np.copysign(np.floor(np.abs(q) + 0.5), q), -32768, 32767).astype(np.int32)

    return _each_block(blocks, "coef", "q", "int", of)


def dequantise(blocks: DataFrame, distance: float, scale: str = "scale") -> DataFrame:
    return _each_block(blocks, "q", "coef", "double", lambda q, batch: q * _steps(batch, distance, scale))


def zigzag_order(n: int = 8) -> list[int]:
    """Diagonals in turn, each in the other direction."""
    return [y * n + x for y, x in sorted(((y, x) for y in range(n) for x in range(n)),
        key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))]


def natural_order(n: int = 8) -> list[int]:
    return [r * n + c for r, c in sorted(((r, c) for r in range(n) for c in range(n)), key=lambda p: (p[0] ** 2 + p[1] ** 2, p[0], p[1]))]


def scan(column: str, order: list[int]) -> Column:
    return let(F.col(column), lambda s: F.transform(F.array(*map(F.lit, order)), lambda i: F.get(s, i)))


def unscan(column: str, order: list[int]) -> Column:
    back = [0] * len(order)
    for k, i in enumerate(order):
        back[i] = k
    return scan(column, back)


def chroma_factor(blocks: DataFrame) -> DataFrame:
    """Of each chroma block, the least-squares factor of luma's AC coefficients in its own, 0 where luma has none: factor,
    and residual with the DC as it is."""
    luma = blocks.where("c = 0").select("image_id", "by", "bx", F.col("coef").alias("luma"))
    d = blocks.where("c > 0").join(luma, ["image_id", "by", "bx"])
    both = F.slice(F.arrays_zip(F.col("luma").alias("l"), F.col("coef").alias("v")), 2, 63)
    sums = let(both, lambda z: F.struct(F.aggregate(z, F.lit(0.0), lambda a, x: a + x["l"] * x["v"]).alias("dot"),
        F.aggregate(z, F.lit(0.0), lambda a, x: a + x["l"] * x["l"]).alias("power")))
    d = d.withColumn("sums", sums).withColumn("factor", F.when(F.col("sums.power") <= 1e-10, 0.0).otherwise(F.col("sums.dot") / F.col("sums.power")))
    residual = let(F.col("factor"),
        lambda f: F.transform(F.zip_with("coef", "luma", lambda v, m: F.struct(v.alias("v"), m.alias("l"))), lambda x,
            i: F.when(i == 0, x["v"]).otherwise(x["v"] - f * x["l"])))
    return d.select(*BLOCK, "luma", "coef", "factor", residual.alias("residual"))


def chroma_rebuild(d: DataFrame) -> DataFrame:
    zipped = F.zip_with("residual", "luma", lambda v, m: F.struct(v.alias("v"), m.alias("l")))
    return d.withColumn("coef", let(F.col("factor"),
        lambda f: F.transform(zipped, lambda x, i: F.when(i == 0, x["v"]).otherwise(x["v"] + f * x["l"]))))


def pass_of(k: Column) -> Column:
    """Progressive pass of the k-th scanned coefficient."""
    return F.when(k == 0, 0).when(k <= 15, 1).otherwise(2)


def up_to_pass(column: str, last: int) -> Column:
    """The scanned coefficients of the passes up to `last`, the others 0."""
    return F.transform(column, lambda v, k: F.when(pass_of(k) <= last, v).otherwise(F.lit(0).cast("int")))


def quality_layers(distance: float, layers: int) -> list[float]:
    """Distances from coarse to fine, in equal ratios."""
    start = min(6.0 * distance, 15.0)
    return [start * (distance / start) ** (i / max(1, layers - 1)) for i in range(layers)]


# fixed values: the limits of block_sizes
def block_sizes(px: DataFrame, width: int, height: int) -> DataFrame:
    """size of each 8 x 8 block by the variances (of samples in 0..1) of itself and of those right, below and across."""
    d = px.groupBy("image_id", "c", F.expr("y div 8").alias("by"),
        F.expr("x div 8").alias("bx")).agg((F.avg(F.col("v") * F.col("v")) - F.avg("v") * F.avg("v")).alias("a"))
    d = d.withColumn("a", F.greatest(F.lit(0.0), F.col("a")))
    across = (width + 7) // 8
    w = Window.partitionBy("image_id", "c").orderBy(F.col("by") * across + F.col("bx"))
    d = d.withColumn("b", F.lead("a", 1).over(w)).withColumn("l", F.lead("a", across).over(w)).withColumn("r", F.lead("a", across + 1).over(w))
    aw, ah = width - F.col("bx") * 8, height - F.col("by") * 8
    top, mean = F.greatest("a", "b", "l", "r"), (F.col("a") + F.col("b") + F.col("l") + F.col("r")) / 4
    h, v = (F.col("a") + F.col("b")) / 2, (F.col("a") + F.col("l")) / 2
    ratio = F.greatest(h, v) / F.greatest(F.lit(1.1754943508222875e-38), F.least(h, v))
    size = (
        F.when((aw < 16) | (ah < 16), "8x8").when(top < 0.005, F.when((aw >= 32) & (ah >= 32), "32x32").otherwise("16x16"))
        .when((ratio > 2) & (mean < 0.05), F.when(h > v, "16x8").otherwise("8x16")).otherwise("8x8")
    )
    return d.select(*BLOCK, "a", size.alias("size"))
