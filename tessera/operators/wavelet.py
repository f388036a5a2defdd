"""Two-channel integer wavelet over rasters: means to the front half, differences to the back half."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import div

KEY = ["image_id", "c", "y", "x"]


def step_plan(width: int, height: int, levels: int = 3) -> list[tuple[str, int, int]]:
    """(axis, width, height) of each step: columns, then rows, on the means of the step before, while there are two samples."""
    out, w, h = [], width, height
    for _ in range(levels):
        if w > 1:
            out.append(("x", w, h))
            w = (w + 1) // 2
        if h > 1:
            out.append(("y", w, h))
            h = (h + 1) // 2
    return out


def _pairs(px: DataFrame, axis: str, width: int, height: int, of: Column, first: Column) -> DataFrame:
    """A row for each pair inside the region, and for each sample outside it (o null): one grouping, the raster read once."""
    inside = (F.col("x") < width) & (F.col("y") < height)
    other = [k for k in KEY if k != axis]
    one = F.when(~inside | first, F.col("v"))
    return px.groupBy(*other, inside.alias("inside"), F.when(inside, of).otherwise(F.col(axis)).alias("i")).agg(F.max(one).alias("e"),
        F.max(F.when(inside & ~first, F.col("v"))).alias("o"))


def _spread(pairs: DataFrame, axis: str, first: tuple[Column, Column], second: tuple[Column, Column]) -> DataFrame:
    """Back to a row a sample: (place, value) of both parts inside, the sample as it is outside."""
    other = [k for k in KEY if k != axis]
    cell = lambda at, v: F.struct(at.cast("long").alias(axis), v.cast("int").alias("v"))
    parts = F.when(F.col("inside"), F.array(cell(*first), cell(*second))).otherwise(F.array(cell(F.col("i"), F.col("e"))))
    return pairs.select(*other, F.explode(parts).alias("p")).select(*other, f"p.{axis}", "p.v").where("v IS NOT NULL").select(*KEY, "v")


def step(px: DataFrame, axis: str, width: int, height: int) -> DataFrame:
    """One step on the region (width, height); the rest passes. An odd last sample joins the means unchanged."""
    half = ((width if axis == "x" else height) + 1) // 2
    pairs = _pairs(px, axis, width, height, div(F.col(axis), 2), F.col(axis) % 2 == 0)
    low = F.when(F.col("o").isNull(), F.col("e")).otherwise(F.shiftright(F.col("e") + F.col("o"), 1))
    return _spread(pairs, axis, (F.col("i"), low), (F.col("i") + half, F.col("e") - F.col("o")))


def undo(px: DataFrame, axis: str, width: int, height: int) -> DataFrame:
    half = ((width if axis == "x" else height) + 1) // 2
    low = F.col(axis) < half
    pairs = _pairs(px, axis, width, height, F.when(low, F.col(axis)).otherwise(F.col(axis) - half), low)
    even = F.col("e") + div(F.col("o") + (F.col("o") >= 0).cast("int"), 2)
    even = F.when(F.col("o").isNull(), F.col("e")).otherwise(even)
    return _spread(pairs, axis, (F.col("i") * 2, even), (F.col("i") * 2 + 1, even - F.col("o")))


def _bands(side_x: int, side_y: int, width: int, height: int, levels: int) -> np.ndarray:
    """For each sample of a transformed tile, in its rows' order: band, and its place and step a tile, (y, dy, x, dx), in the
    transformed picture. A tile of 2**levels samples a side holds whole pairs of all levels, so it is transformed alone."""
    size, out = 1 << levels, []
    for y in range(side_y):
        for x in range(side_x):
            w, h, gw, gh = side_x, side_y, width, height
            for n in range(1, levels + 1):
                w, gw = (w + 1) // 2, (gw + 1) // 2
                if x >= w:
                    out.append((2 * n - 1, y, size >> (n - 1), gw + x - w, size >> n))
                    break
                h, gh = (h + 1) // 2, (gh + 1) // 2
                if y >= h:
                    out.append((2 * n, gh + y - h, size >> n, x, size >> n))
                    break
                if n == levels:
                    out.append((0, y, 1, x, 1))
    return np.array(out, np.int64).reshape(-1, 5)


def _tile(t: np.ndarray, levels: int, inverse: bool) -> np.ndarray:
    """All steps on tiles (n, rows, columns), in place and back."""
    t = t.astype(np.int64)
    w, h, plan = t.shape[2], t.shape[1], []
    for _ in range(levels):
        plan.append((2, w, h))
        w = (w + 1) // 2
        plan.append((1, w, h))
        h = (h + 1) // 2
    for axis, w, h in reversed(plan) if inverse else plan:
        part = np.moveaxis(t[:, :h, :w], axis, 2)
        n = part.shape[2]
        half, pairs = (n + 1) // 2, n // 2
        if not pairs:
            continue
        out = part.copy()
        if inverse:
            low, diff = part[:, :, :half], part[:, :, half:]
            up = diff + (diff >= 0)
            even = low[:, :, :pairs] + np.where(up >= 0, up // 2, -(-up // 2))
            out[:, :, 0 : 2 * pairs : 2], out[:, :, 1 : 2 * pairs : 2] = even, even - diff
            if half > pairs:
                out[:, :, n - 1] = low[:, :, half - 1]
        else:
            even, odd = part[:, :, 0 : 2 * pairs : 2], part[:, :, 1 : 2 * pairs : 2]
            out[:, :, :pairs], out[:, :, half:] = (even + odd) >> 1, even - odd
            if half > pairs:
                out[:, :, half - 1] = part[:, :, n - 1]
        t[:, :h, :w] = np.moveaxis(out, 2, axis)
    return t


def _by_tiles(tiles: DataFrame, width: int, height: int, levels: int, inverse: bool) -> DataFrame:
    """From rows (image_id, c, ty, tx, v: the samples in row order, or in the order of bands) back to a row a sample."""
    size = 1 << levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = {k: batch.column(k).to_numpy() for k in ("image_id", "c", "ty", "tx")}
            side_x, side_y = np.minimum(size, width - size * ids["tx"]), np.minimum(size, height - size * ids["ty"])
            offsets, flat = batch.column("v").offsets.to_numpy(), batch.column("v").values.to_numpy()
            for sx, sy in {*zip(side_x.tolist(), side_y.tolist(), strict=True)}:
                here = np.flatnonzero((side_x == sx) & (side_y == sy))
                values = flat[offsets[here][:, None] + np.arange(sx * sy)]
                bands = _bands(sx, sy, width, height, levels)
                if inverse:
                    order = np.lexsort((bands[:, 3], bands[:, 1], bands[:, 0]))
                    laid = np.empty_like(values)
                    laid[:, order] = values
                    result = _tile(laid.reshape(-1, sy, sx), levels, True).reshape(len(here), -1)
                    y, x = np.divmod(np.arange(sx * sy), sx)
                    y, x = ids["ty"][here][:, None] * size + y, ids["tx"][here][:, None] * size + x
                else:
                    result = _tile(values.reshape(-1, sy, sx), levels, False).reshape(len(here), -1)
                    y = ids["ty"][here][:, None] * bands[:, 2] + bands[:, 1]
                    x = ids["tx"][here][:, None] * bands[:, 4] + bands[:, 3]
                whole = [np.repeat(ids[k][here], sx * sy) for k in ("image_id", "c")]
                yield pa.RecordBatch.from_arrays([pa.array(k) for k in (*whole, y.ravel(), x.ravel())] + [pa.array(result.ravel().astype(np.int32))],
                    names=[*KEY, "v"])

    return tiles.mapInArrow(run, "image_id long, c long, y long, x long, v int")


def forward(px: DataFrame, width: int, height: int, levels: int = 3) -> DataFrame:
    """All steps of step_plan: one grouping into tiles that are transformed on their own."""
    size = 1 << levels
    cell = F.struct("y", "x", F.col("v").cast("int").alias("v"))
    d = px.groupBy(*[F.col(k).cast("long").alias(k) for k in ("image_id", "c")], F.expr(f"CAST(y div {size} AS LONG)").alias("ty"),
        F.expr(f"CAST(x div {size} AS LONG)").alias("tx"))
    d = d.agg(F.array_sort(F.collect_list(cell)).alias("s")).select("image_id", "c", "ty", "tx", F.transform("s", lambda s: s["v"]).alias("v"))
    return _by_tiles(d, width, height, levels, False)


def inverse(px: DataFrame, width: int, height: int, levels: int = 3) -> DataFrame:
    """The samples of forward()'s raster: each place names its band and tile."""
    size, gw, gh = 1 << levels, width, height
    band, ty, tx = F.lit(0), F.col("y"), F.col("x")
    cases = []
    for n in range(1, levels + 1):
        gw, gh = (gw + 1) // 2, (gh + 1) // 2
        cases.append((F.col("x") >= gw, 2 * n - 1, div(F.col("y"), size >> (n - 1)), div(F.col("x") - gw, size >> n)))
        cases.append((F.col("y") >= gh, 2 * n, div(F.col("y") - gh, size >> n), div(F.col("x"), size >> n)))
    for when, name, y, x in reversed(cases):  # the first case that holds decides
        band, ty, tx = F.when(when, name).otherwise(band), F.when(when, y).otherwise(ty), F.when(when, x).otherwise(tx)
    cell = F.struct(band.alias("b"), "y", "x", F.col("v").cast("int").alias("v"))
    d = px.groupBy(*[F.col(k).cast("long").alias(k) for k in ("image_id", "c")], ty.cast("long").alias("ty"), tx.cast("long").alias("tx"))
    d = d.agg(F.array_sort(F.collect_list(cell)).alias("s")).select("image_id", "c", "ty", "tx", F.transform("s", lambda s: s["v"]).alias("v"))
    return _by_tiles(d, width, height, levels, True)
