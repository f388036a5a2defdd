"""Prediction from decided neighbours, contexts and runs, in raster order.

All neighbours come from one window over (image, channel): one shuffle and one sort give the sample before, above and
beside. Only what depends on its own earlier output (the extended tree, reconstruction) runs per plane in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bit_length, clamp, div, fold_sign

PLANE = ["image_id", "c"]


def _raster(width: int):
    return Window.partitionBy(*PLANE).orderBy(F.col("y") * width + F.col("x"))


def neighbours(px: DataFrame, width: int, value: str = "v") -> DataFrame:
    """n, w, nw and ne of each sample; null outside the picture."""
    r = _raster(width)
    return (
        px.withColumn("n", F.lag(value, width).over(r))
        .withColumn("w", F.when(F.col("x") > 0, F.lag(value, 1).over(r)))
        .withColumn("nw", F.when(F.col("x") > 0, F.lag(value, width + 1).over(r)))
        .withColumn("ne", F.when(F.col("x") < width - 1, F.lag(value, width - 1).over(r)) if width > 1 else F.lit(None))
    )


def _clamped_gradient(n: Column, w: Column, nw: Column) -> Column:
    return clamp(n + w - nw, 0, 65535)


def gradient_predict(px: DataFrame, width: int) -> DataFrame:
    """p: n + w - nw clamped; the first row takes w, the first column n, the origin 0. r: v - p."""
    n, w, nw = F.col("n"), F.col("w"), F.col("nw")
    p = F.when(n.isNull() & w.isNull(), 0).when(n.isNull(), w).when(w.isNull(), n).otherwise(_clamped_gradient(n, w, nw))
    return neighbours(px, width).withColumn("p", p.cast("int")).withColumn("r", F.col("v") - F.col("p"))


def predictors(n: Column, w: Column, nw: Column) -> dict[str, Column]:
    """The eight predictions from neighbours that are 0 outside the picture."""
    return {
        "zero": F.lit(0), "west": w, "north": n, "average_wn": div(w + n, 2), "gradient": _clamped_gradient(n, w, nw),
        "select": F.when(F.abs(n - nw) < F.abs(w - nw), w).otherwise(n), "average_wnw": div(w + nw, 2), "average_nnw": div(n + nw, 2),
    }


def all_predictors(px: DataFrame, width: int) -> DataFrame:
    d = neighbours(px, width)
    for k in ("n", "w", "nw"):
        d = d.withColumn(k, F.coalesce(k, F.lit(0)))
    origin = (F.col("x") == 0) & (F.col("y") == 0)
    return d.select("image_id", "c", "y", "x",
        *[F.when(origin, 0).otherwise(e).cast("int").alias(k) for k, e in predictors(F.col("n"), F.col("w"), F.col("nw")).items()])


def properties(px: DataFrame, width: int) -> DataFrame:
    """What decisions look at. A neighbour outside the picture is replaced by the nearest one inside; zn, zw and znw are
    the same neighbours with 0 outside, as predictors see them."""
    n, w = F.coalesce("n", "w", F.lit(0)), F.coalesce("w", "n", F.lit(0))
    nw = F.when(F.col("n").isNotNull() & F.col("w").isNotNull(), F.col("nw")).otherwise(F.coalesce("n", "w", F.lit(0)))
    ne = F.when(F.col("n").isNotNull(), F.coalesce("ne", "n")).otherwise(n)
    plain = [F.coalesce(k, F.lit(0)).alias("z" + k) for k in ("n", "w", "nw")]  # what predictors see
    d = neighbours(px, width).select("image_id", "c", "y", "x", "v", n.alias("n"), w.alias("w"), nw.alias("nw"), ne.alias("ne"), *plain)
    n, w, nw = F.col("n"), F.col("w"), F.col("nw")
    return d.withColumns({"gradient_h": F.abs(w - nw), "gradient_v": F.abs(n - nw), "w_nw": w - nw, "n_nw": n - nw, "n_ne": n - F.col("ne")})


class Decision:
    """value of the property <= threshold: left, else right."""

    def __init__(self, prop: str, threshold: int, left, right):
        self.prop, self.threshold, self.left, self.right = prop, threshold, left, right


#: Leaves are (predictor, context).
DEFAULT_TREE = Decision("gradient_h", 16, Decision("gradient_v", 16, ("gradient", 0), ("west", 1)),
    Decision("gradient_v", 16, ("north", 2), ("select", 3)))
EXTENDED_TREE = Decision(
    "gradient_h", 16,
    Decision("gradient_v", 16, Decision("max_residual", 4, ("gradient", 0), ("gradient", 1)), Decision("n_nw", 0, ("average_wnw", 2), ("west", 3))),
    Decision("gradient_v", 16, Decision("w_nw", 0, ("average_nnw", 4), ("north", 5)), Decision("max_residual", 64, ("select", 6), ("zero", 7))),
)


def walk(tree, leaf) -> Column:
    """A tree as nested CASE expressions."""
    if isinstance(tree, tuple):
        return leaf(tree)
    return F.when(F.col(tree.prop) <= tree.threshold, walk(tree.left, leaf)).otherwise(walk(tree.right, leaf))


def tree_predict(px: DataFrame, width: int, tree: Decision = DEFAULT_TREE) -> DataFrame:
    """context, p and r for a tree that looks at samples alone: fully parallel."""
    d = properties(px, width)
    p = predictors(F.col("zn"), F.col("zw"), F.col("znw"))
    origin = (F.col("x") == 0) & (F.col("y") == 0)
    d = d.withColumn("context", walk(tree, lambda t: F.lit(t[1]))).withColumn("p",
        F.when(origin, 0).otherwise(walk(tree, lambda t: p[t[0]])).cast("int"))
    return d.select("image_id", "c", "y", "x", "v", "context", "p", (F.col("v") - F.col("p")).alias("r"))


def _diagonals(height: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(y, x) of each anti-diagonal in turn: all neighbours of its samples lie on those before."""
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        yield y, d - y


def _plane_walk(values: np.ndarray, tree, inverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """The extended tree over a plane, a diagonal at a time; inverse: values are residuals, and samples are rebuilt."""
    h, w = values.shape
    v, r = np.zeros((2, h + 1, w + 1), np.int64)  # with a row above and a column before
    ctx = np.zeros((h, w), np.int64)
    (r if inverse else v)[1:, 1:] = values
    for y, x in _diagonals(h, w):
        n, wv, nw = v[y, x + 1], v[y + 1, x], v[y, x]
        pn, pw = np.where(y > 0, n, wv), np.where(x > 0, wv, n)
        pnw = np.where((y > 0) & (x > 0), nw, np.where(y > 0, n, wv))
        around = np.maximum.reduce([np.abs(r[y, x + 1]), np.abs(r[y + 1, x]), np.abs(r[y, x])])
        props = {"gradient_h": np.abs(pw - pnw), "gradient_v": np.abs(pn - pnw), "w_nw": pw - pnw, "n_nw": pn - pnw, "max_residual": around}
        kinds = {
            "zero": np.zeros_like(n), "west": wv, "north": n, "average_wn": (wv + n) // 2, "gradient": np.clip(n + wv - nw, 0, 65535),
            "select": np.where(np.abs(n - nw) < np.abs(wv - nw), wv, n), "average_wnw": (wv + nw) // 2, "average_nnw": (n + nw) // 2,
        }

        def leaf(t) -> tuple[np.ndarray, np.ndarray]:
            if isinstance(t, tuple):
                return kinds[t[0]], np.full_like(n, t[1])
            low = props[t.prop] <= t.threshold
            return tuple(np.where(low, a, b) for a, b in zip(leaf(t.left), leaf(t.right), strict=True))

        p, ctx[y, x] = leaf(tree)
        p = np.where((x > 0) | (y > 0), p, 0)
        if inverse:
            v[y + 1, x + 1] = p + r[y + 1, x + 1]
        else:
            r[y + 1, x + 1] = v[y + 1, x + 1] - p
    return (v if inverse else r)[1:, 1:], ctx


def undo_gradient(residuals: DataFrame, width: int, height: int) -> DataFrame:
    """v of gradient_predict's r, a plane at a time and in it a diagonal at a time."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        r, v = np.zeros((height, width), np.int64), np.zeros((height + 1, width + 1), np.int64)
        r[frame["y"], frame["x"]] = frame["r"]
        for y, x in _diagonals(height, width):
            n, w, nw = v[y, x + 1], v[y + 1, x], v[y, x]
            p = np.where(y == 0, w, np.where(x == 0, n, np.clip(n + w - nw, 0, 65535)))
            v[y + 1, x + 1] = r[y, x] + p
        y, x = np.divmod(np.arange(width * height), width)
        return pd.DataFrame({"image_id": frame["image_id"].iloc[0], "c": frame["c"].iloc[0], "y": y, "x": x, "v": v[1:, 1:].ravel()})

    return residuals.select(*PLANE, "y", "x", "r").groupBy(*PLANE).applyInPandas(run, "image_id long, c long, y long, x long, v long")


def _per_plane(px: DataFrame, width: int, height: int, value: str, out: str, inverse: bool, tree=EXTENDED_TREE) -> DataFrame:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        plane = np.zeros((height, width), np.int64)
        plane[frame["y"], frame["x"]] = frame[value]
        result, ctx = _plane_walk(plane, tree, inverse)
        y, x = np.divmod(np.arange(width * height), width)
        return pd.DataFrame({"image_id": frame["image_id"].iloc[0], "c": frame["c"].iloc[0], "y": y, "x": x, out: result.ravel(),
            "context": ctx.ravel()})

    return px.groupBy(*PLANE).applyInPandas(run, f"image_id long, c long, y long, x long, {out} long, context long")


def extended_residuals(px: DataFrame, width: int, height: int) -> DataFrame:
    """r and context by the extended tree, which looks at earlier residuals: sequential within a plane."""
    return _per_plane(px, width, height, "v", "r", False)


def extended_rebuild(residuals: DataFrame, width: int, height: int) -> DataFrame:
    return _per_plane(residuals, width, height, "r", "v", True)


def residual_contexts(residuals: DataFrame, width: int) -> DataFrame:
    """Entropy context of each residual: the mean size of the three decided ones around it (0 outside the picture), in
    four classes, and whether the one above is larger than the one before."""
    d = neighbours(residuals.withColumn("a", F.abs("r")), width, "a")
    n, w, nw = (F.coalesce(k, F.lit(0)) for k in ("n", "w", "nw"))
    mean = div(n + w + nw, 3)
    size = F.when(mean == 0, 0).when(mean < 16, 1).when(mean < 256, 2).otherwise(3)
    return d.select("image_id", "c", "y", "x", "r", (size * 2 + (n > w).cast("int")).cast("int").alias("context"))


def max_residual(residuals: DataFrame, width: int) -> DataFrame:
    """The largest size of the three decided residuals around each one: the tree's property of what came before."""
    d = neighbours(residuals.withColumn("a", F.abs("r")), width, "a")
    largest = F.greatest(*[F.coalesce(k, F.lit(0)) for k in ("n", "w", "nw")])
    return d.select("image_id", "c", "y", "x", largest.cast("int").alias("max_residual"))


def rice_parameters(contexts: DataFrame) -> DataFrame:
    """floor(log2(mean)) of the folded residuals of each context; 0 where the mean is 0."""
    d = contexts.withColumn("u", fold_sign(F.col("r"))).groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.sum("u").cast("long").alias("total"))
    mean = F.expr("total div n")
    return d.withColumn("k", F.greatest(F.lit(0), bit_length(mean) - 1).cast("int"))


def runs(rows: DataFrame, width: int, *keys: str) -> DataFrame:
    """Runs of equal keys in raster order: (start, length) and the keys' values. Gaps and islands, no recursion."""
    r = _raster(width)
    pos = F.col("y") * width + F.col("x")
    changed = reduce(lambda a, b: a | b, [~F.lag(k, 1).over(r).eqNullSafe(F.col(k)) for k in keys]) | (F.row_number().over(r) == 1)
    d = rows.withColumn("pos", pos).withColumn("island", F.sum(changed.cast("int")).over(r))
    return d.groupBy(*PLANE, "island", *keys).agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("length")).drop("island")


def expand_runs(run_rows: DataFrame, width: int, *keys: str) -> DataFrame:
    d = run_rows.withColumn("pos", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)))
    return d.select(*PLANE, F.expr(f"pos div {width}").alias("y"), (F.col("pos") % width).alias("x"), *keys)


def dc_residuals(dc: DataFrame) -> DataFrame:
    """(image_id, c, by, bx, dc): minus the truncated mean of the block before and above, or the one there is."""
    left = F.lag("dc", 1).over(Window.partitionBy(*PLANE, "by").orderBy("bx"))
    above = F.lag("dc", 1).over(Window.partitionBy(*PLANE, "bx").orderBy("by"))
    d = dc.withColumn("l", left).withColumn("a", above)
    p = F.when(F.col("l").isNotNull() & F.col("a").isNotNull(), div(F.col("l") + F.col("a"), 2)).otherwise(F.coalesce("l", "a", F.lit(0)))
    return d.withColumn("p", p).select(*PLANE, "by", "bx", "dc", "p", (F.col("dc") - F.col("p")).alias("residual"))


def zero_runs(coefficients: DataFrame, *block: str) -> DataFrame:
    """(block, k, q) with k from 1 to 63: the zeros before each other coefficient, and an end row (k 64, q null) with the
    trailing zeros, if there are any. One window: the last coefficient's row stands for the end where it is 0."""
    before = Window.partitionBy(*block).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    here = (F.col("k") > 0) & (F.col("q") != 0)
    d = coefficients.select(*block, "k", "q",
        F.coalesce(F.max(F.when(here, F.col("k"))).over(before), F.lit(0)).alias("last")).where(here | (F.col("k") == 63))
    number = lambda v, name: v.cast("int").alias(name)
    k, zeros = F.when(here, F.col("k")).otherwise(64), F.when(here, F.col("k") - F.col("last") - 1).otherwise(63 - F.col("last"))
    return d.select(*block, number(k, "k"), number(F.when(here, F.col("q")), "q"), number(zeros, "zeros"))


def keyframes(frames: DataFrame, interval: int, max_delta: int) -> DataFrame:
    """Whether each frame is a key, and the last key at or before it: every min(interval, max_delta + 1) frames."""
    step = min(interval, max_delta + 1)
    d = frames.select("frame_id").distinct().withColumn("is_key", F.col("frame_id") % step == 0)
    return d.withColumn("key_id", (F.col("frame_id") - F.col("frame_id") % step).cast("long"))
