"""Frame sequences: block search against a reference frame, patches, deltas against key frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import div


def block_rows(px: DataFrame, size: int) -> DataFrame:
    """(image_id, by, bx, samples): all channels of a block in one array."""
    cell = F.struct("c", "y", "x", "v")
    d = px.groupBy("image_id", F.expr(f"y div {size}").alias("by"),
        F.expr(f"x div {size}").alias("bx")).agg(F.array_sort(F.collect_list(cell)).alias("s"))
    return d.select("image_id", "by", "bx", F.transform("s", lambda p: p["v"]).alias("samples"))


def search(px: DataFrame, size: int, radius: int, threshold: float, peak: int = 255) -> DataFrame:
    """For each block the most similar block of the picture before within `radius` blocks: 1 - SAD / (n * peak), 0 below the
    threshold. Of equal ones the first by row and column. Offsets are listed and joined by equality: (2 radius + 1)^2
    rows a block, never blocks against all blocks."""
    blocks = block_rows(px, size)
    offsets = F.sequence(F.lit(-radius), F.lit(radius))
    wanted = blocks.withColumn("dy", F.explode(offsets)).withColumn("dx", F.explode(offsets))
    wanted = wanted.select("image_id", "by", "bx", "samples", (F.col("image_id") - 1).alias("ref"), (F.col("by") + F.col("dy")).alias("sy"),
        (F.col("bx") + F.col("dx")).alias("sx"))
    found = wanted.join(blocks.select(F.col("image_id").alias("ref"), F.col("by").alias("sy"), F.col("bx").alias("sx"),
        F.col("samples").alias("other")), ["ref", "sy", "sx"])
    sad = F.aggregate(F.zip_with("samples", "other", lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda acc, v: acc + v)
    sim = 1 - sad / (F.size("samples") * F.lit(float(peak)))
    found = found.withColumn("s", sim).withColumn("similarity", F.when(F.col("s") >= threshold, F.col("s")).otherwise(0.0))
    best = F.row_number().over(Window.partitionBy("image_id", "by", "bx").orderBy(F.desc("similarity"), "sy", "sx"))
    return found.withColumn("rank", best).where("rank = 1 AND similarity > 0").select("image_id", "by", "bx", "sy", "sx", "similarity")


def largest(patches: DataFrame, most: int) -> DataFrame:
    """The first `most` patches of each picture by falling area."""
    w = Window.partitionBy("image_id").orderBy(F.desc(F.col("w") * F.col("h")), "y", "x")
    return patches.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def merge_rows(found: DataFrame, size: int) -> DataFrame:
    """Neighbouring blocks of a row with one displacement become one patch: gaps and islands."""
    keys = ["image_id", "by", "dy", "dx"]
    d = found.select("image_id", "by", "bx", (F.col("sy") - F.col("by")).alias("dy"), (F.col("sx") - F.col("bx")).alias("dx"))
    d = d.withColumn("island", F.col("bx") - F.row_number().over(Window.partitionBy(*keys).orderBy("bx")))
    d = d.groupBy(*keys, "island").agg(F.min("bx").alias("bx"), F.count(F.lit(1)).alias("blocks"))
    return d.select("image_id", (F.col("by") * size).alias("y"), (F.col("bx") * size).alias("x"), (F.col("blocks") * size).alias("w"),
        F.lit(size).cast("long").alias("h"), "dy", "dx")


def overlap(a: str, b: str) -> Column:
    """Whether two rectangles (x, y, w, h) overlap."""
    f = lambda t, n: F.col(f"{t}.{n}")
    return (f(a, "x") < f(b, "x") + f(b, "w")) & (f(b, "x") < f(a, "x") + f(a, "w")) & (f(a, "y") < f(b, "y") + f(b, "h")) & (f(b, "y") < f(a,
        "y") + f(a, "h"))


def overlapping_pairs(patches: DataFrame, cell: int) -> DataFrame:
    """Pairs of overlapping patches of a picture. Patches are dealt to the grid cells they touch and joined by cell; of the
    cells a pair shares, only that of its common corner reports it."""
    span = lambda at, size: F.sequence(div(F.col(at), cell), div(F.col(at) + F.col(size) - 1, cell))
    d = patches.withColumn("gy", F.explode(span("y", "h"))).withColumn("gx", F.explode(span("x", "w")))
    a, b = d.alias("a"), d.alias("b")
    j = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.gy") == F.col("b.gy")) & (F.col("a.gx") == F.col("b.gx")) & (F.col("a.patch") < F.col("b.patch")) & overlap("a", "b"))
    corner = (F.col("a.gy") == div(F.greatest("a.y", "b.y"), cell)) & (F.col("a.gx") == div(F.greatest("a.x", "b.x"), cell))
    return j.where(corner).select(F.col("a.image_id").alias("image_id"), F.col("a.patch").alias("a"), F.col("b.patch").alias("b"))


def merge_greedy(patches: DataFrame) -> DataFrame:
    """Patches of one displacement that together form a rectangle are joined until none do: order matters, so a picture's
    patches meet in one group."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        held = sorted(zip(*(frame[k].astype(int) for k in ("y", "x", "h", "w", "dy", "dx")), strict=True))
        again = True
        while again:
            again = False
            for i, a in enumerate(held):
                for j in range(i + 1, len(held)):
                    b = held[j]
                    side = a[0] == b[0] and a[2] == b[2] and (a[1] + a[3] == b[1] or b[1] + b[3] == a[1])
                    over = a[1] == b[1] and a[3] == b[3] and (a[0] + a[2] == b[0] or b[0] + b[2] == a[0])
                    if a[4:] == b[4:] and (side or over):
                        y, x = min(a[0], b[0]), min(a[1], b[1])
                        held[i] = (y, x, a[2] + b[2] * over, a[3] + b[3] * side, *a[4:])
                        del held[j]
                        again = True
                        break
                if again:
                    break
        y, x, h, w, dy, dx = zip(*held, strict=True)
        return pd.DataFrame({"image_id": frame["image_id"].iloc[0], "y": y, "x": x, "h": h, "w": w, "dy": dy, "dx": dx})

    return patches.groupBy("image_id").applyInPandas(run, "image_id long, y long, x long, h long, w long, dy long, dx long")


def key_deltas(px: DataFrame, step: int) -> DataFrame:
    """Samples minus those of the last key frame at or before: an as-of join, whose key is arithmetic here."""
    keys = px.where(F.col("image_id") % step == 0).select(F.col("image_id").alias("key_id"), "c", "y", "x", F.col("v").alias("k"))
    d = px.withColumn("key_id", F.col("image_id") - F.col("image_id") % step).join(keys, ["key_id", "c", "y", "x"])
    return d.select("image_id", "key_id", "c", "y", "x", (F.col("v") - F.col("k")).alias("delta"))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Each left row with the last right value at or before it: one union, one sort, a running last value."""
    both = left.select(by, at, F.lit(None).cast(right.schema[value].dataType).alias(value),
        F.lit(1).alias("side")).unionByName(right.select(by, at, value, F.lit(0).alias("side")))
    w = Window.partitionBy(by).orderBy(at, "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, True).over(w)).where("side = 1").drop("side")


def durations(frames: DataFrame, given: list[int], ticks: int = 1000, fps: int = 30) -> DataFrame:
    """Duration of each frame, the given ones first, and where it starts: a running sum."""
    listed = F.array(*map(F.lit, given)) if given else F.array().cast("array<int>")
    d = frames.select("frame_id").distinct().withColumn("duration",
        F.coalesce(F.get(listed, F.col("frame_id").cast("int")), F.lit(ticks // fps)).cast("long"))
    return offsets(d, "frame_id", "duration")


def offsets(rows: DataFrame, order: str, size: str, part: int = 4096) -> DataFrame:
    """start: the running sum of what comes before in order, without one task for all rows: rows are summed within parts of
    the (dense) order, and the parts' sums before each part."""
    p = F.expr(f"CAST({order} AS LONG) div {part}")
    d = rows.withColumn("__part", p)
    w = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = d.groupBy("__part").agg(F.sum(size).alias("__sum")).withColumn("__before",
        F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.withColumn("__in", F.coalesce(F.sum(size).over(w), F.lit(0))).join(before.select("__part", "__before"), "__part")
    return d.withColumn("start", (F.col("__before") + F.col("__in")).cast("long")).drop("__part", "__before", "__in")


def gaussian_noise(spark, n: int, seed: int, sigma: float = 1.0, streams: int = 8) -> DataFrame:
    """(stream, i, u1, u2, z): pairs of uniforms of an xorshift generator and their Box-Muller value."""
    from ..sources.rasters import xorshift

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for stream in frame["id"]:
                state, u = seed + int(stream) * 7919 + 1, []
                for _ in range(2 * n):
                    state, value = xorshift(state)
                    u.append((value >> 40) / float(1 << 24))
                u1, u2 = np.array(u[::2]), np.array(u[1::2])
                yield pd.DataFrame({"stream": stream, "i": np.arange(n), "u1": u1, "u2": u2,
                    "z": sigma * np.sqrt(-2 * np.log(np.maximum(u1, 1e-10))) * np.cos(2 * np.pi * u2)})

    return spark.range(streams).repartition(streams, "id").mapInPandas(run, "stream long, i long, u1 double, u2 double, z double")


def box_muller(u1: Column, u2: Column, sigma: float = 1.0) -> Column:
    return sigma * F.sqrt(-2.0 * F.ln(F.greatest(u1, F.lit(1e-10)))) * F.cos(2.0 * 3.141592653589793 * u2)


def noise_weight(i: Column) -> Column:
    """Weight of noise on coefficient i: little on the mean, half on the lowest frequencies."""
    return F.when(i == 0, 0.1).when(i < 8, 0.5).otherwise(1.0)


def block_differences(px: DataFrame, size: int, radius: int) -> DataFrame:
    """Sum of absolute differences of each block and each block of the picture before within `radius`."""
    blocks = block_rows(px, size)
    offsets = F.sequence(F.lit(-radius), F.lit(radius))
    wanted = blocks.withColumn("dy", F.explode(offsets)).withColumn("dx", F.explode(offsets)).withColumn("ref", F.col("image_id") - 1)
    wanted = wanted.withColumn("sy", F.col("by") + F.col("dy")).withColumn("sx", F.col("bx") + F.col("dx"))
    found = wanted.join(blocks.select(F.col("image_id").alias("ref"), F.col("by").alias("sy"), F.col("bx").alias("sx"),
        F.col("samples").alias("other")), ["ref", "sy", "sx"])
    sad = F.aggregate(F.zip_with("samples", "other", lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda acc, v: acc + v)
    return found.select("image_id", "by", "bx", "dy", "dx", sad.alias("sad"), F.size("samples").alias("n"))


def grow(differences: DataFrame, threshold: float, most: int, peak: int = 255) -> DataFrame:
    """Largest square (in blocks) from each block at each displacement whose similarity, and that of all smaller ones,
    reaches the threshold. A block's difference is dealt to the squares that hold it: most * (most + 1) * (2 most + 1) / 6
    rows each, whatever the picture's size."""
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)),
        lambda n: F.flatten(F.transform(F.sequence(F.lit(0), n - 1),
            lambda i: F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(n.alias("side"), i.alias("i"), j.alias("j")))))))
    d = differences.withColumn("s", F.explode(spans)).select("image_id", (F.col("by") - F.col("s.i")).alias("by"),
        (F.col("bx") - F.col("s.j")).alias("bx"), "dy", "dx", F.col("s.side").alias("side"), "sad", "n")
    sums = d.groupBy("image_id", "by", "bx", "dy", "dx", "side").agg(F.sum("sad").alias("sad"), F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("blocks"))
    good = sums.where((F.col("blocks") == F.col("side") * F.col("side")) & (1 - F.col("sad") / (F.col("n") * float(peak)) >= threshold))
    return good.groupBy("image_id", "by", "bx", "dy", "dx").agg(F.array_sort(F.collect_list("side")).alias("sides")).select("image_id", "by", "bx",
        "dy", "dx", F.size(F.filter("sides", lambda v, i: v == i + 1)).alias("side")).where("side > 0")


def pixel_gaussian(seed: int, *keys: str) -> Column:
    """A normal deviate for each pixel from a hash of its place: the same on any cluster, in any order."""
    uniform = lambda n: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(n), *keys), 11).cast("double") + 0.5) * 2.0**-53
    return box_muller(uniform(1), uniform(2), 1.0)


def add_noise(value: Column, deviate: Column, amplitude: float, strength: Column, peak: float = 255.0) -> Column:
    """A sample with noise of a twentieth of the peak times amplitude and strength, clamped."""
    return F.greatest(F.lit(0.0), F.least(F.lit(peak), value + deviate * amplitude * strength * peak * 0.05))


def noisy_coefficients(px: DataFrame, amplitude: float, strength: float, deviate: Column) -> DataFrame:
    """Rows (.., i, v: coefficient i of its block) with noise that grows from the mean to the high frequencies."""
    return px.withColumn("v", F.col("v") + deviate * amplitude * strength * noise_weight(F.col("i")) * 2.0)
