"""Rasters as rows: views over stored tables, synthetic pictures, and files.

A raster is a DataFrame (image_id, c, y, x, v): image, channel, row, column, sample. Generators start from spark.range, so
a picture of any size is made in parallel; only the pseudo-random one is sequential, and runs per picture.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["image_id", "c", "y", "x"]
SIDE = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 x 32 RGB pictures out of 48 vectors each (3 channels of 4 x 4 blocks of 64 values)."""
    vectors = table(spark, sf_dir, "embeddings")
    whole = vectors.agg((F.floor(F.count(F.lit(1)) / 48) * 48).alias("n")).scalar()
    value = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(F.col("e").cast("double") * 256 + 128.5).cast("double")))
    return vectors.where(F.col("vec_id") < whole).select("vec_id", F.posexplode("embedding").alias("i", "e")).select(
        F.expr("vec_id div 48").alias("image_id"), F.expr("(vec_id % 48) div 16").alias("c"),
        F.expr("((vec_id % 16) div 4) * 8 + i div 8").alias("y"), F.expr("(vec_id % 4) * 8 + i % 8").alias("x"), value.cast("int").alias("v"),
    )


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 x 16 grey frames out of 256 events each, in id order."""
    events = table(spark, sf_dir, "events")
    whole = events.agg((F.floor(F.count(F.lit(1)) / 256) * 256).alias("n")).scalar()
    return events.where(F.col("event_id") < whole).select(
        F.expr("event_id div 256").alias("image_id"), F.lit(0).cast("long").alias("c"), F.expr("(event_id % 256) div 16").alias("y"),
        F.expr("event_id % 16").alias("x"), F.floor(F.least("value", F.lit(255.0))).cast("int").alias("v"),
    )


def grid(spark: SparkSession, width: int, height: int, channels: int = 3) -> DataFrame:
    """The (c, y, x) of a picture."""
    n = width * height
    return spark.range(n * channels).select(F.expr(f"id div {n}").alias("c"), F.expr(f"(id % {n}) div {width}").alias("y"),
        F.expr(f"id % {width}").alias("x"))


def _by_channel(values: list[Column]) -> Column:
    out = F.when(F.col("c") == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(F.col("c") == i, v)
    return out


def _trunc(x: Column) -> Column:
    return F.floor(x).cast("int")


def gradient(spark: SparkSession, width: int, height: int, channels: int = 3) -> DataFrame:
    """r over columns, g over rows, b over the diagonal, a fourth channel opaque; integer arithmetic."""
    x, y = f"x * 255 div {max(width - 1, 1)}", f"y * 255 div {max(height - 1, 1)}"
    values = [F.expr(x), F.expr(y), F.expr(f"(x + y) * 255 div {max(width + height - 2, 1)}"), F.lit(255)]
    return grid(spark, width, height, channels).withColumn("v", _by_channel(values[:channels]).cast("int"))


def checkerboard(spark: SparkSession, width: int, height: int, block: int = 8, channels: int = 3) -> DataFrame:
    return grid(spark, width, height, channels).withColumn("v", F.expr(f"CASE WHEN (x div {block} + y div {block}) % 2 = 0 THEN 255 ELSE 0 END"))


def solid(spark: SparkSession, width: int, height: int, colour: list[int]) -> DataFrame:
    return grid(spark, width, height, len(colour)).withColumn("v", F.element_at(F.array(*map(F.lit, colour)), (F.col("c") + 1).cast("int")))


def pattern(spark: SparkSession, width: int, height: int) -> DataFrame:
    """Product, sum and exclusive or of the coordinates, modulo 256."""
    x, y = F.col("x"), F.col("y")
    return grid(spark, width, height).withColumn("v", _by_channel([x * y % 256, (x + y) % 256, x.bitwiseXOR(y) % 256]).cast("int"))


def xorshift(state: int) -> tuple[int, int]:
    """The next state of a 64-bit xorshift* generator, and its output."""
    state ^= state >> 12
    state ^= (state << 25) & 0xFFFFFFFFFFFFFFFF
    state ^= state >> 27
    return state, (state * 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF


def noise(spark: SparkSession, width: int, height: int, seeds: list[int], channels: int = 3) -> DataFrame:
    """A picture for each seed; the generator's top bytes in the order row, column, channel. A seed of 0 counts as 1."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for image, seed in zip(frame["image_id"], frame["seed"], strict=True):
                state, out = int(seed) or 1, np.empty(width * height * channels, np.int32)
                for i in range(len(out)):
                    state, value = xorshift(state)
                    out[i] = value >> 56
                i = np.arange(len(out))
                yield pd.DataFrame({"image_id": image, "c": i % channels, "y": i // (channels * width), "x": i // channels % width, "v": out})

    rows = spark.createDataFrame(list(enumerate(seeds)), "image_id long, seed long").repartition(len(seeds), "image_id")
    return rows.mapInPandas(run, "image_id long, c long, y long, x long, v int")


def _sun(u: Column, t: Column, x: float, y: float) -> Column:
    """Squared distance to a point."""
    return (u - x) * (u - x) + (t - y) * (t - y)


def _inside(v: Column, low: float, high: float) -> Column:
    return (v > low) & (v < high)


def _choose(cases: list[tuple[Column, tuple]], other: tuple) -> list[Column]:
    """Per channel, the value of the first case that holds."""
    out = []
    for k in range(3):
        value = F.when(cases[0][0], cases[0][1][k])
        for when, colour in cases[1:]:
            value = value.when(when, colour[k])
        out.append(value.otherwise(other[k]))
    return out


def _listed(index: Column, *channels: tuple[int, ...]) -> list[Column]:
    return [F.element_at(F.array(*map(F.lit, c)), (index + 1).cast("int")) for c in channels]


def _portrait(u: Column, t: Column) -> list[Column]:
    e = (u - 0.5) * (u - 0.5) / 0.08 + (t - 0.45) * (t - 0.45) / 0.13
    return _choose([(e < 1, (225 - 35 * e, 180 - 40 * e, 150 - 45 * e))], (50 + 20 * t, 80 + 30 * t, 110 + 30 * t))


def _meadow(u: Column, t: Column) -> list[Column]:
    grass = (60 + 25 * F.sin(31 * u + 47 * t), 130 + 40 * F.sin(41 * u) * F.cos(53 * t), 50)
    return _choose([(t < 0.4, (135, 185 + 40 * t, 235))], grass)


def _mixed(u: Column, t: Column) -> list[Column]:
    check = (F.floor(u * 16) + F.floor(t * 16)) % 2 == 0
    return _choose([(u < 0.5, (255 * t, 510 * u, 90)), (check, (230, 230, 230))], (25, 25, 25))


def _diagram(u: Column, t: Column) -> list[Column]:
    line = (F.abs(t - 0.5) < 0.02) | (F.abs(u - 0.5) < 0.02)
    first, second = (_inside(u, a, b) & _inside(t, a, b) for a, b in ((0.1, 0.35), (0.65, 0.9)))
    return _choose([(line, (30, 30, 30)), (first, (90, 160, 220)), (second, (220, 150, 80))], (255, 255, 255))


def _poster(u: Column, t: Column) -> list[Column]:
    return _choose([(_sun(u, t, 0.5, 0.5) < 0.09, (230, 70, 60)), (t > 0.5 + F.abs(u - 0.5), (40, 90, 160))], (245, 220, 150))


def _letters(u: Column, t: Column) -> list[Column]:
    ink = (F.floor(t * 32) % 8 < 5) & ((F.floor(u * 32) * 7 + F.floor(t * 4) * 5 + F.floor(u * 11) * 11) % 4 != 0)
    return _choose([(ink, (20, 20, 25))], (245, 245, 240))


def _leaf(u: Column, t: Column) -> list[Column]:
    m = F.abs(F.sin(9 * u + 4 * t) + F.sin(11 * t - 3 * u)) / 2
    return [30 + 60 * m, 90 + 120 * m, 20 + 40 * m]


def _window(u: Column, t: Column) -> list[Column]:
    return _choose([(t < 0.1, (35, 45, 90)), (_inside(u, 0.6, 0.9) & _inside(t, 0.8, 0.92), (40, 140, 90))], (250, 250, 248))


#: name: (set, category, channels out of the pixel centre's place (u, t), each from 0 to 1)
PICTURES = {
    "dusk": ("a", "gradient", lambda u, t: [60 + 140 * t, 70 + 60 * t * (1 - u), 190 - 120 * t]),
    "spotlight": ("a", "gradient", lambda u, t: [a / (1 + b * _sun(u, t, 0.3, 0.6)) for a, b in ((230, 6), (210, 9), (160, 14))]),
    "tiles": ("a", "edges", lambda u,
        t: _listed((F.floor(u * 6) * 2 + F.floor(t * 6) * 3) % 5, (12, 240, 128, 60, 200), (200, 30, 128, 90, 220), (90, 60, 10, 180, 30))),
    "ripples": ("a", "texture", lambda u,
        t: [127.5 + 100 * F.sin(20 * u) * F.cos(14 * t), 127.5 + 90 * F.cos(17 * u + 9 * t), 127.5 + 80 * F.sin(23 * t)]),
    "portrait": ("a", "photographic", _portrait),
    "meadow": ("a", "photographic", _meadow),
    "window": ("a", "screen", _window),
    "mixed": ("a", "mixed", _mixed),
    "bars": ("b", "synthetic", lambda u,
        t: _listed(F.floor(u * 7), (200, 30, 30, 200, 90, 240, 10), (40, 180, 60, 190, 90, 240, 10), (50, 70, 200, 40, 90, 240, 10))),
    "rings": ("b", "synthetic", lambda u, t: [127.5 + 120 * F.cos(180 * _sun(u, t, 0.5, 0.5))] * 3),
    "shallow": ("b", "gradient", lambda u, t: [100 + 8 * u, 104 + 8 * t, 108 + 4 * (u + t)]),
    "dots": ("b", "edges", lambda u, t: _choose([((F.floor(u * 32) % 9 == 4) & (F.floor(t * 32) % 7 == 3), (255, 255, 255))], (0, 0, 0))),
    "diagram": ("c", "diagram", _diagram),
    "leaf": ("c", "nature", _leaf),
    "poster": ("c", "illustration", _poster),
    "letters": ("c", "text", _letters),
}


def picture(spark: SparkSession, name: str, width: int, height: int) -> DataFrame:
    u, t = (F.col("x") + 0.5) / float(width), (F.col("y") + 0.5) / float(height)
    return grid(spark, width, height).withColumn("v", _by_channel([_trunc(F.lit(v) if isinstance(v, int) else v) for v in PICTURES[name][2](u, t)]))


def corpus(spark: SparkSession, width: int, height: int, sets: str = "abc") -> DataFrame:
    """All named pictures of the sets together, with set, name and category."""
    parts = [
        picture(spark, n, width, height).select(F.lit(s).alias("set"), F.lit(n).alias("name"), F.lit(c).alias("category"), "c", "y", "x", "v")
        for n, (s, c, _) in PICTURES.items()
        if s in sets
    ]
    return reduce(DataFrame.unionByName, parts)


def list_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Files below a folder, sorted by path; their contents aren't read unless asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", "modificationTime").orderBy("path")
