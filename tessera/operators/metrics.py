"""Picture quality and raster statistics: grouped aggregates over aligned pixels (a original, b degraded)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.scalar import let
from .colour import opponent

KEY = ["image_id", "c", "y", "x"]
K1, K2 = 0.01, 0.03
WEIGHTS = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels of two rasters side by side."""
    return a.select(*KEY, F.col("v").alias("a")).join(b.select(*KEY, F.col("v").alias("b")), KEY)


def unmatched(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each picture, the pixels of a that b lacks: 0 where the shapes agree."""
    lone = a.join(b.select(*KEY), KEY, "left_anti").groupBy("image_id").agg(F.count(F.lit(1)).alias("lone"))
    return a.select("image_id").distinct().join(lone, "image_id", "left").select("image_id", F.coalesce("lone", F.lit(0)).alias("lone"))


def _db(mse: Column, peak: float) -> Column:
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(peak * peak / mse))


def psnr(pair: DataFrame, peak: float = 255.0) -> DataFrame:
    """Per channel, and overall (c null) from the mean of the channels' errors: a picture's few channels as one array."""
    d = pair.groupBy("image_id", "c").agg(F.avg((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("mse"))
    row = F.struct(F.col("c").cast("long").alias("c"), "mse")
    whole = F.struct(F.lit(None).cast("long").alias("c"), F.avg("mse").alias("mse"))
    d = d.groupBy("image_id").agg(F.concat(F.collect_list(row), F.array(whole)).alias("rows"))
    return d.select("image_id", F.inline("rows")).withColumn("psnr", _db(F.col("mse"), peak))


def pooled_psnr(pair: DataFrame, peak: float = 255.0) -> DataFrame:
    d = pair.where("c < 3").groupBy("image_id").agg(F.avg((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("mse"))
    return d.select("image_id", _db(F.col("mse"), peak).alias("psnr"))


def _moments() -> list[Column]:
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    return [F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(a * a).alias("aa"), F.avg(b * b).alias("bb"), F.avg(a * b).alias("ab")]


def _parts(peak: float) -> tuple[Column, Column]:
    c1, c2 = (K1 * peak) ** 2, (K2 * peak) ** 2
    ma, mb = F.col("ma"), F.col("mb")
    lum = (2 * ma * mb + c1) / (ma * ma + mb * mb + c1)
    cs = (2 * (F.col("ab") - ma * mb) + c2) / ((F.col("aa") - ma * ma) + (F.col("bb") - mb * mb) + c2)
    return lum, cs


def _starts(at: str, size: int, step: int) -> Column:
    """The starts of all windows of 8 that hold a position."""
    first = F.greatest(F.lit(0), F.ceil((F.col(at) - 7) / step) * step).cast("int")
    last = F.least(F.lit((size - 8) // step * step), F.floor(F.col(at) / step) * step).cast("int")
    return F.when(first <= last, F.sequence(first, last, F.lit(step)))


def ssim(pair: DataFrame, width: int, height: int, peak: float = 255.0) -> DataFrame:
    """Mean over windows of 8 x 8 with a stride of a 32nd of the side, then over channels. Each pixel goes to the windows
    that hold it (at most 64), whose moments are combined before the shuffle. Below 8 x 8 there is no window, and no row."""
    if width < 8 or height < 8:
        return pair.select("image_id", F.lit(0.0).alias("ssim")).where("false")
    d = pair.withColumn("wy", F.explode(_starts("y", height, max(1, height // 32)))).withColumn("wx",
        F.explode(_starts("x", width, max(1, width // 32))))
    lum, cs = _parts(peak)
    windows = d.groupBy("image_id", "c", "wy", "wx").agg(*_moments()).select("image_id", "c", (lum * cs).alias("s"))
    return windows.groupBy("image_id", "c").agg(F.avg("s").alias("s")).groupBy("image_id").agg(F.avg("s").alias("ssim"))


def downsample(px: DataFrame, width: int, height: int, *values: str) -> DataFrame:
    """Means of 2 x 2 samples; an odd last row or column goes."""
    d = px.where((F.col("x") < width // 2 * 2) & (F.col("y") < height // 2 * 2))
    return d.groupBy("image_id", "c", F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")).agg(*[F.avg(v).alias(v) for v in values])


def ms_ssim(pair: DataFrame, width: int, height: int, peak: float = 255.0) -> DataFrame:
    """Product over up to five scales of the contrast-structure means to their weights, the last with luminance too."""
    levels, w, h = 1, width, height
    while levels < 5 and w // 2 >= 8 and h // 2 >= 8:
        levels, w, h = levels + 1, w // 2, h // 2
    lum, cs = _parts(peak)
    factors, d, w, h = [], pair, width, height
    for i in range(levels):
        inside = d.where((F.col("x") < w // 8 * 8) & (F.col("y") < h // 8 * 8))
        windows = inside.groupBy("image_id", "c", F.expr("y div 8").alias("wy"), F.expr("x div 8").alias("wx")).agg(*_moments())
        scale = windows.groupBy("image_id").agg(F.avg(lum).alias("lum"), F.avg(cs).alias("cs"))
        part = F.pow(F.greatest(F.lit(0.0), F.col("cs")), F.lit(WEIGHTS[i]))
        if i == levels - 1:
            part = part * F.pow(F.greatest(F.lit(0.0), F.col("lum")), F.lit(WEIGHTS[i]))
        factors.append(scale.select("image_id", part.alias(f"f{i}")))
        d, w, h = downsample(d, w, h, "a", "b"), w // 2, h // 2
    joined = reduce(lambda a, b: a.join(b, "image_id"), factors)
    return joined.select("image_id", F.least(F.lit(1.0), reduce(lambda a, b: a * b, [F.col(f"f{i}") for i in range(levels)])).alias("ms_ssim"))


def perceptual_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Opponent differences, masked by the original's size, weighted 1, 0.7, 0.3: 0.6 of the worst pixel, 0.4 of the mean."""
    pair = align(opponent(a), opponent(b))
    masked = F.abs(F.col("a") - F.col("b")) / (1.0 + 0.3 * F.greatest(F.abs("a"), F.lit(1.0)))
    weight = F.when(F.col("c") == 0, 1.0).when(F.col("c") == 1, 0.7).otherwise(0.3)
    d = pair.groupBy("image_id", "y", "x").agg(F.sqrt(F.sum(masked * masked * weight)).alias("d"))
    return d.groupBy("image_id").agg((0.6 * F.max("d") + 0.4 * F.avg("d")).alias("distance"))


def byte_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, data binary) against (id, data binary): sizes, their ratio (null where a is empty), differing bytes (a missing one
    differs), and the first differing offset, or -1."""
    d = a.select("id", F.col("data").alias("a")).join(b.select("id", F.col("data").alias("b")), "id", "full")
    d = d.select("id", F.coalesce("a", F.lit(b"")).alias("a"), F.coalesce("b", F.lit(b"")).alias("b"))

    def compare(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int, int]:
        n = min(len(x), len(y))
        odd = x[:n] != y[:n]
        differing = int(np.count_nonzero(odd))
        first = int(odd.argmax()) if differing else n if len(x) != len(y) else -1
        return len(x), len(y), differing + max(len(x), len(y)) - n, first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view = lambda v: np.frombuffer(v.as_buffer(), np.uint8)
        for batch in batches:
            found = [compare(view(x), view(y)) for x, y in zip(batch.column("a"), batch.column("b"), strict=True)]
            columns = np.array(found, np.int32).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, columns)], names=["id", *names])

    names = ["size_a", "size_b", "differing", "first_offset"]
    out = d.mapInArrow(run, StructType([d.schema["id"], *(StructField(n, IntegerType()) for n in names)]))
    return out.select("id", *names, F.try_divide("size_b", "size_a").alias("ratio"))


def vector_statistics(v: DataFrame, column: str = "embedding") -> DataFrame:
    """Sum, mean, population deviation, norm and extremes of an array column, without exploding it."""
    e = F.transform(column, lambda x: x.cast("double"))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x)
    n = F.size(column)
    return v.select("vec_id", total.alias("total"), (total / n).alias("mean"),
        F.sqrt(F.greatest(F.lit(0.0), squares / n - (total / n) * (total / n))).alias("deviation"), F.sqrt(squares).alias("norm"),
            F.array_max(e).alias("largest"), F.array_min(e).alias("smallest"))


def normalised(v: DataFrame, column: str = "embedding") -> DataFrame:
    """Centred on its mean and scaled to length one; a constant vector is only centred."""
    wide = F.transform(column, lambda x: x.cast("double"))
    centred = let(wide, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x) / F.size(e), lambda m: F.transform(e, lambda x: x - m)))
    scaled = let(centred, lambda e: let(F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x)),
        lambda s: F.when(s > 0, F.transform(e, lambda x: x / s)).otherwise(e)))
    return v.select("vec_id", scaled.alias("e"))


def resize_nearest(px: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Each source pixel is copied to the targets that take it: no join."""
    def targets(at: str, size: int, to: int) -> Column:
        first = F.ceil(F.col(at) * to / size).cast("int")
        last = F.when(F.col(at) == size - 1, F.lit(to - 1)).otherwise((F.ceil((F.col(at) + 1) * to / size) - 1).cast("int"))
        return F.when(first <= last, F.sequence(first, last))

    d = px.withColumn("ty", F.explode(targets("y", height, to_height))).withColumn("tx", F.explode(targets("x", width, to_width)))
    return d.select("image_id", "c", F.col("ty").cast("long").alias("y"), F.col("tx").cast("long").alias("x"), "v")


def interleave(px: DataFrame, width: int, components: int, opaque: int = 255) -> DataFrame:
    """A picture's samples in the order row, column, component as one array; a component it lacks is opaque."""
    full = px.groupBy("image_id", "y",
        "x").agg(*[F.coalesce(F.max(F.when(F.col("c") == i, F.col("v"))), F.lit(opaque)).alias(f"s{i}") for i in range(components)])
    cell = F.struct((F.col("y") * width + F.col("x")).alias("i"), F.array(*[f"s{i}" for i in range(components)]).alias("s"))
    return full.groupBy("image_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(cell)), lambda p: p["s"])).alias("samples"))


def to_bytes(samples: Column, bytes_each: int = 1) -> Column:
    """Samples as unsigned big-endian integers."""
    digits = 2 * bytes_each
    return F.unhex(F.array_join(F.transform(samples, lambda s: F.lpad(F.hex(s), digits, "0")), ""))


def tiles(px: DataFrame, tile: int, width: int, height: int) -> DataFrame:
    """Tiles, those at the edges partial: origin, size, and the sum of their samples."""
    ty, tx = F.expr(f"y div {tile}"), F.expr(f"x div {tile}")
    d = px.groupBy("image_id", "c", ty.alias("ty"), tx.alias("tx")).agg(F.sum("v").cast("long").alias("total"), F.count(F.lit(1)).alias("n"))
    return d.withColumn("w", F.least(F.lit(tile), width - F.col("tx") * tile).cast("int")).withColumn("h",
        F.least(F.lit(tile), height - F.col("ty") * tile).cast("int"))
