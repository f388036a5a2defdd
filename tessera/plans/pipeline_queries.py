"""Whole chains: a picture through the lossy and the lossless path, and what each costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import blocks as B
from ..operators import colour as C
from ..operators import metrics as A
from ..operators import motion as M
from ..operators import prediction as P
from ..operators import wavelet as W
from ..sources import rasters as R
from .raster_queries import _ACT, _Q, _STEP, BK, KEYS, K, _scanned
from .registry import EV, PX, longs, query, r4, s4


def lossy(px: DataFrame, distance: float, last_pass: int = 2) -> DataFrame:
    """Blocks, transform, adaptive quantisation, scan; then back with the coefficients of the passes up to `last_pass`."""
    blocks = B.extract(px).withColumn("scale", B.adaptive_scale(B.activity(F.col("coef"))))
    coded = B.quantise(B.dct(blocks), distance).withColumn("s", B.scan("q", B.zigzag_order()))
    kept = coded.withColumn("s", B.up_to_pass("s", last_pass)).withColumn("q", B.unscan("s", B.zigzag_order()))
    back = B.place(B.idct(B.dequantise(kept, distance)))
    return back.withColumn("v", S.clamp(F.round("v"), 0.0, 255.0).cast("int"))


_BACK = f"""{_Q}, dq AS (SELECT {BK}, w, u, q * ({_STEP("s")}) AS v FROM q), ih AS (SELECT {BK}, w, i, sum(dq.v * b) AS v FROM dq JOIN basis ON k = u GROUP BY ALL),
  ip AS (SELECT {BK}, j, ih.i AS i, sum(ih.v * t.b) AS v FROM ih JOIN (SELECT k, i AS j, b FROM basis) t ON t.k = ih.w GROUP BY ALL),
  rec AS (SELECT image_id, c, "by" * 8 + j AS y, bx * 8 + i AS x, greatest(0, least(255, round(v)))::INT AS v FROM ip)"""


@query("lossy_psnr", (
    f"WITH {_BACK}, m AS (SELECT image_id, c, avg((p.v - r.v) * (p.v - r.v)) AS mse FROM px p JOIN rec r USING ({K}) GROUP BY ALL) SELECT "
    f"image_id, {s4('avg(mse)')} AS mse, round(10 * log10(65025 / avg(mse)), 4) AS psnr FROM m GROUP BY 1"
))
def lossy_psnr(spark, sf):
    px = R.embedding_pictures(spark, sf)
    d = A.psnr(A.align(px, lossy(px, 1.1))).where("c IS NULL")
    return d.select(*longs("image_id"), r4(F.col("mse")).alias("mse"), F.round("psnr", 4).alias("psnr"))


@query("lossy_pixels", f"WITH {_BACK} SELECT {K}, v FROM rec")
def lossy_pixels(spark, sf):
    return lossy(R.embedding_pictures(spark, sf), 1.1).select(*longs(*KEYS), "v")


@query("lossy_symbols", (
    f"WITH {_Q} SELECT CASE WHEN w + u = 0 THEN 0 ELSE 1 END::INT AS context, CASE WHEN q >= 0 THEN 2 * q ELSE -2 * q - 1 END::INT AS sym, "
    f"count(*) AS n FROM q GROUP BY ALL"
))
def lossy_symbols(spark, sf):
    """The symbols of the coder: context 0 for means, 1 for all others."""
    d = _scanned(spark, sf).select(F.posexplode("s").alias("k", "q"))
    return d.groupBy((F.col("k") > 0).cast("int").alias("context"),
        S.fold_sign(F.col("q")).cast("int").alias("sym")).agg(F.count(F.lit(1)).alias("n"))


@query("block_coding_cost", f"WITH {_ACT} SELECT image_id, c, count(*) AS blocks, {s4('avg(a)')} AS activity, {s4('avg(s)')} AS scale FROM sc GROUP BY ALL")
def block_coding_cost(spark, sf):
    d = B.extract(R.embedding_pictures(spark, sf)).withColumn("a", B.activity(F.col("coef")))
    return d.groupBy(*longs("image_id", "c")).agg(F.count(F.lit(1)).alias("blocks"), r4(F.avg("a")).alias("activity"),
        r4(F.avg(B.adaptive_scale(F.col("a")))).alias("scale"))


@query("lossless_round_trip", f"WITH {PX} SELECT {K}, v FROM px")
def lossless_round_trip(spark, sf):
    return _lossless(R.embedding_pictures(spark, sf))


def _lossless(px: DataFrame) -> DataFrame:
    """Colour transform, extended prediction and wavelet of the residuals, and all the way back."""
    ycc = C.rct_forward(px).withColumn("v", F.col("v") + 256)  # differences as samples
    coded = W.forward(P.extended_residuals(ycc, 32, 32).select(*KEYS, F.col("r").cast("int").alias("v")), 32, 32)
    back = P.extended_rebuild(W.inverse(coded, 32, 32).withColumnRenamed("v", "r"), 32, 32)
    return C.rct_inverse(back.select(*KEYS, (F.col("v") - 256).cast("int").alias("v"))).select(*longs(*KEYS), F.col("v").cast("int").alias("v"))


_LUMA = ["0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b", "-0.168736::DOUBLE * r - 0.331264::DOUBLE * g + 0.5::DOUBLE * b",
    "0.5::DOUBLE * r - 0.418688::DOUBLE * g - 0.081312::DOUBLE * b"]
_WIDE = (
    f"WITH {PX}, t AS (SELECT image_id, y, x, max(v) FILTER (c = 0) / 255.0::DOUBLE AS r, max(v) FILTER (c = 1) / 255.0::DOUBLE AS g, "
    f"max(v) FILTER (c = 2) / 255.0::DOUBLE AS b FROM px GROUP BY ALL)"
)


@query("interleaved_ycbcr", (
    f"{_WIDE} SELECT image_id, (y * 32 + x)::INT AS i, {s4(_LUMA[0])} AS luma, {s4(_LUMA[1] + ' + 0.5')} AS cb, {s4(_LUMA[2] + ' + 0.5')} "
    f"AS cr FROM t"
))
def interleaved_ycbcr(spark, sf):
    """All three channels of interleaved samples, as the array kernels do it: triples by position in one array."""
    d = A.interleave(R.embedding_pictures(spark, sf), 32, 3)
    # fixed values: BT.601
    weights = {"luma": (0.299, 0.587, 0.114, 0.0), "cb": (-0.168736, -0.331264, 0.5, 0.5), "cr": (0.5, -0.418688, -0.081312, 0.5)}
    mix = lambda s, i, w: sum((F.get(s, i * 3 + k) / 255 * w[k] for k in range(3)), F.lit(w[3]))
    triple = lambda s, i: F.struct(*[mix(s, i, w).alias(k) for k, w in weights.items()])
    rows = S.let(F.col("samples"), lambda s: F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: triple(s, i)))
    return d.select(*longs("image_id"), F.posexplode(rows).alias("i", "v")).select("image_id", F.col("i").cast("int").alias("i"),
        *[r4(F.col(f"v.{k}")).alias(k) for k in weights])


@query("patch_growth", f"""WITH {EV}, blk AS (SELECT image_id, y // 4 AS bty, x // 4 AS btx, y % 4 AS j, x % 4 AS i, v FROM ev),
  d AS (SELECT a.image_id, a.bty, a.btx, b.bty - a.bty AS dy, b.btx - a.btx AS dx, sum(abs(a.v - b.v)) AS sad FROM blk a JOIN blk b ON b.image_id = a.image_id - 1 AND abs(a.bty - b.bty) <= 1 AND abs(a.btx - b.btx) <= 1 AND a.i = b.i AND a.j = b.j GROUP BY ALL),
  g AS (SELECT d.image_id, d.bty, d.btx, d.dy, d.dx, n, sum(e.sad) AS sad, count(*) AS k FROM d JOIN range(1, 4) t(n) ON true JOIN d e ON e.image_id = d.image_id AND e.dy = d.dy AND e.dx = d.dx AND e.bty BETWEEN d.bty AND d.bty + n - 1 AND e.btx BETWEEN d.btx AND d.btx + n - 1 GROUP BY ALL),
  ok AS (SELECT *, k = n * n AND 1 - sad / (k * 16 * 255.0::DOUBLE) >= 0.7 AS ok FROM g),
  f AS (SELECT image_id, bty, btx, dy, dx, coalesce(min(n) FILTER (NOT ok), 4) - 1 AS side FROM ok GROUP BY ALL) SELECT image_id, bty AS block_y, btx AS block_x, dy, dx, side::INT AS side FROM f WHERE side > 0""")
def patch_growth(spark, sf):
    d = M.grow(M.block_differences(R.event_frames(spark, sf), 4, 1), 0.7, 3)
    return d.select(*longs("image_id"), F.col("by").alias("block_y"), F.col("bx").alias("block_x"), *longs("dy", "dx"),
        F.col("side").cast("int").alias("side"))
