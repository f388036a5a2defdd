"""Queries of coded bytes, headers as bits, conformance, and settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.presets import PRESETS, presets
from ..operators import blocks as B
from ..operators import coding as K
from ..operators import conformance as V
from ..operators import entropy as E
from ..operators import metrics as A
from ..operators import motion as M
from ..operators import prediction as P
from ..operators import reports as T
from ..sources import containers as X
from ..sources import rasters as R
from .analysis_queries import _BENCH, _NORM, _NOW, _bench, _headers, _now_and_base, _symbols
from .pipeline_queries import _BACK
from .raster_queries import _Q, _RES, _SCAN, _STEP, BK, KEYS, K as KEY
from .registry import PX, longs, query, r4, s4

# bytes out of the chains


def _residual_sections(spark, sf):
    return K.plane_sections(P.gradient_predict(R.embedding_pictures(spark, sf), 32), 32, 32)


@query("coded_planes")
def coded_planes(spark, sf):
    """Bytes of each plane's section of residuals."""
    return _residual_sections(spark, sf).select(*longs("image_id", "c"), F.octet_length("data").alias("bytes"), F.crc32("data").alias("checksum"))


@query("decoded_planes", f"WITH {PX} SELECT {KEY}, v FROM px")
def decoded_planes(spark, sf):
    """The samples, from the sections' bytes alone."""
    return V.decode_lossless(_residual_sections(spark, sf), 32, 32).select(*longs(*KEYS), F.col("v").cast("int").alias("v"))


def _block_sections(spark, sf):
    return V.encode_lossy(R.embedding_pictures(spark, sf), 32, 32, 1.1)


@query("coded_blocks")
def coded_blocks(spark, sf):
    """Bytes of each channel's section of each pass."""
    return _block_sections(spark, sf).select(*longs("image_id", "c"), "pass", F.octet_length("data").alias("bytes"),
        F.crc32("data").alias("checksum"))


@query("decoded_blocks", f"WITH {_BACK} SELECT {KEY}, v FROM rec")
def decoded_blocks(spark, sf):
    """What the lossy path gives back, from the sections' bytes alone."""
    return V.decode_lossy(_block_sections(spark, sf), 32, 32, 1.1).select(*longs(*KEYS), F.col("v").cast("int").alias("v"))


_PASSES = f"""{_SCAN}, qp AS (SELECT {BK}, p, w, u, s, CASE WHEN k <= [0, 15, 63][p + 1] THEN q.q ELSE 0 END AS q FROM q JOIN zz USING (w, u), range(3) t(p)),
  dq AS (SELECT {BK}, p, w, u, q * ({_STEP("s")}) AS v FROM qp), ih AS (SELECT {BK}, p, w, i, sum(dq.v * b) AS v FROM dq JOIN basis ON k = u GROUP BY ALL),
  ip AS (SELECT {BK}, p, j, ih.i AS i, sum(ih.v * t.b) AS v FROM ih JOIN (SELECT k, i AS j, b FROM basis) t ON t.k = ih.w GROUP BY ALL),
  rec AS (SELECT image_id, c, p, "by" * 8 + j AS y, bx * 8 + i AS x, greatest(0, least(255, round(v)))::INT AS v FROM ip),
  m AS (SELECT image_id, p, c, avg((o.v - r.v) * (o.v - r.v)) AS mse FROM px o JOIN rec r USING ({KEY}) GROUP BY ALL)"""


@query("progressive_psnr", f"WITH {_PASSES} SELECT image_id, p::INT AS pass, {s4('avg(mse)')} AS mse FROM m GROUP BY ALL")
def progressive_psnr(spark, sf):
    """Quality grows with each pass: a row a picture and pass; the blocks are transformed and coded once."""
    px = R.embedding_pictures(spark, sf)
    blocks = B.extract(px).withColumn("scale", B.adaptive_scale(B.activity(F.col("coef"))))
    coded = B.quantise(B.dct(blocks), 1.1).withColumn("s", B.scan("q", B.zigzag_order()))
    coded = coded.withColumn("pass", F.explode(F.array(*map(F.lit, range(3)))))
    kept = coded.withColumn("s", F.transform("s", lambda v, k: F.when(B.pass_of(k) <= F.col("pass"), v).otherwise(F.lit(0).cast("int"))))
    kept = kept.select(*B.BLOCK, "pass", "scale", B.unscan("s", B.zigzag_order()).alias("q"))
    back = B.idct(B.dequantise(kept, 1.1)).withColumn("image_id", F.col("image_id") * 3 + F.col("pass"))
    rec = B.place(back).select("image_id", "c", "y", "x", F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round("v"))).cast("int").alias("v"))
    three = px.withColumn("image_id", F.explode(F.array(*[F.col("image_id") * 3 + p for p in range(3)])))
    d = A.psnr(A.align(three, rec)).where("c IS NULL")
    return d.select(F.expr("image_id div 3").alias("image_id"), (F.col("image_id") % 3).cast("int").alias("pass"), r4(F.col("mse")).alias("mse"))


@query("progressive_decoded", f"WITH {_PASSES} SELECT image_id, {s4('avg(mse)')} AS mse FROM m WHERE p = 1 GROUP BY ALL")
def progressive_decoded(spark, sf):
    """The picture after the second pass, read from the bytes of the first two."""
    px = R.embedding_pictures(spark, sf)
    d = A.psnr(A.align(px, V.decode_lossy(_block_sections(spark, sf), 32, 32, 1.1, 1))).where("c IS NULL")
    return d.select(*longs("image_id"), r4(F.col("mse")).alias("mse"))


@query("match_sections")
def match_sections(spark, sf):
    """Matches of symbol streams as entropy-coded bytes, read back."""
    return K.match_sections(E.split_streams(_symbols(spark, sf), 8))


@query("clustered_sections")
def clustered_sections(spark, sf):
    """Symbols coded with two clusters of contexts in place of the contexts."""
    symbols = _symbols(spark, sf)
    clustered = symbols.join(F.broadcast(E.cluster(E.histogram(symbols), 2)), "ctx").select("pos", "sym", F.col("cluster").alias("ctx"))
    return E.rans_round_trip(E.split_streams(clustered)).select("stream", "n", "coded", "exact")


@query("frequency_tables", (
    f"WITH {_NORM}, a AS (SELECT c.ctx, s.sym, coalesce(d.freq, 0) AS f FROM (SELECT DISTINCT ctx FROM dist) c JOIN range(32) s(sym) ON "
    f"true LEFT JOIN dist d ON d.ctx = c.ctx AND d.sym = s.sym) SELECT ctx, '0020' || string_agg(format('{{:04X}}', f), '' ORDER BY sym) AS "
    f"raw, true AS exact FROM a GROUP BY 1"
))
def frequency_tables(spark, sf):
    """Each context's table as bytes; exact: it reads back in both forms."""
    return K.tables_as_bytes(E.normalise(E.histogram(_symbols(spark, sf))), 32).select("ctx", F.hex("raw").alias("raw"), "exact")


_GROUP = lambda i: f"format('{{:02X}}', ((n >> {7 * i}) & 127) + CASE WHEN n >= {1 << 7 * (i + 1)} THEN 128 ELSE 0 END)"


@query("varints", "SELECT event_id, " + " || ".join(f"CASE WHEN {i} = 0 OR n >= {1 << 7 * i} THEN {_GROUP(i)} ELSE '' END" for i in range(5)) + " AS bytes, n AS back FROM (SELECT event_id, event_id * event_id AS n FROM events)")
def varints(spark, sf):
    n = K.varint_column(F.col("event_id") * F.col("event_id"))
    return R.table(spark, sf, "events").select("event_id", F.hex(n).alias("bytes"), K.read_varint_column(n).alias("back"))


@query("dct_shapes", f"WITH {PX} SELECT s.shape, {KEY}, v FROM px, (VALUES {', '.join(f'({chr(39)}{w}x{h}{chr(39)})' for w, h in B.SIZES)}) s(shape)")
def dct_shapes(spark, sf):
    """Transform and inverse in all nine block shapes."""
    px = R.embedding_pictures(spark, sf)
    parts = []
    for w, h in B.SIZES:
        back = B.place(B.idct(B.dct(B.extract(px, w, h), w, h), w, h), w, h)
        parts.append(back.select(F.lit(f"{w}x{h}").alias("shape"), *longs(*KEYS), F.round("v").cast("int").alias("v")))
    return V._union(parts)


# headers as bits

_COLOURS = {"srgb": "1", "linear": "000000" + "00" + "010" + "01", "grey": "000100" + "011" + "01", "cmyk": "1", "custom": "01"}
_SPACE = "['srgb', 'linear', 'grey', 'cmyk', 'custom'][event_id % 5 + 1]"
_COLOUR = "CASE " + _SPACE + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _COLOURS.items()) + " END"


def _space():
    return F.element_at(F.array(*map(F.lit, ("srgb", "linear", "grey", "cmyk", "custom"))), (F.col("event_id") % 5 + 1).cast("int"))


@query("colour_bits", f"SELECT event_id, {_COLOUR} AS bits FROM events")
def colour_bits(spark, sf):
    return R.table(spark, sf, "events").select("event_id", X.colour_bits(_space()).alias("bits"))


_DEPTH = "[8, 8, 12, 16, 32][event_id % 5 + 1]"
_META = f"""SELECT event_id, CASE WHEN event_id % 30 = 0 THEN '1' ELSE '0' || CASE {_DEPTH} WHEN 8 THEN '1' WHEN 32 THEN '010' || format('{{:032b}}', 32) ELSE '001' || format('{{:016b}}', {_DEPTH}) END
  || CASE WHEN event_id % 2 = 1 THEN '1' || format('{{:08b}}', event_id % 3) ELSE '0' || CASE WHEN event_id % 3 > 0 THEN format('{{:08b}}', event_id % 3) ELSE '' END END
  || CASE WHEN event_id % 6 = 5 THEN '1' ELSE '0' END || {_COLOUR} || CASE WHEN event_id % 6 = 0 THEN '1' ELSE '0' || format('{{:03b}}', event_id % 6) END
  || CASE WHEN event_id % 5 < 4 THEN '0' ELSE '1' || format('{{:032b}}', event_id % 5 * 6) || format('{{:032b}}', 1) || format('{{:032b}}', event_id % 7) END END AS bits FROM events"""


@query("metadata_bits", f"SELECT event_id, bits, ((length(bits) + 7) // 8)::INT AS bytes FROM ({_META})")
def metadata_bits(spark, sf):
    e = F.col("event_id")
    depth = F.element_at(F.array(*map(F.lit, (8, 8, 12, 16, 32))), (e % 5 + 1).cast("int"))
    ticks = F.when(e % 5 < 4, 0).otherwise(e % 5 * 6)
    m = {"depth": depth, "alpha": e % 2 == 1, "extra": e % 3, "xyb": e % 6 == 5, "space": _space(), "orientation": e % 6 + 1, "ticks": ticks,
        "per": F.lit(1), "loops": e % 7}
    d = R.table(spark, sf, "events").select("event_id", X.metadata_bits(m).alias("bits"))
    return d.select("event_id", "bits", F.octet_length(X.pack_bits(F.col("bits"))).alias("bytes"))


_BOX = lambda kind, data: f"format('{{:08X}}', octet_length({data}) + 8) || hex('{kind}') || hex({data})"


@query("container_builder", f"""SELECT doc_id AS file_id, '0000000C' || hex('JXL ') || '0D0A870A' || '00000014' || hex('ftyp') || hex('jxl ') || '00000000' || hex('jxl ') || '00000009' || hex('jxll') || '0A'
  || {_BOX('xml ', "encode('<x>' || doc_id || '</x>')")} || {_BOX('jhgm', "encode(coalesce(lang, ''))")} || {_BOX('jxlc', "encode(coalesce(text, ''))")} AS bytes FROM documents""")
def container_builder(spark, sf):
    whole = lambda c: F.encode(F.coalesce(c, F.lit("")), "utf-8")
    box = X.Container(whole("text")).thumbnail(whole("lang")).xml(F.concat(F.lit("<x>"), F.col("doc_id").cast("string"), F.lit("</x>"))).level(10)
    return R.table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.hex(box.build()).alias("bytes"))


# checks

_VECTORS = ", ".join(f"('{v[0]}', '{v[1]}')" for v in V.VECTORS)
_CHECKS = "['least_size', 'signature', 'content', 'bare', 'sides', 'channels', 'frame', 'exact', 'psnr']"


@query("conformance_checks", f"SELECT id, category, unnest({_CHECKS}) AS name, true AS passed FROM (VALUES {_VECTORS}) t(id, category)")
def conformance_checks(spark, sf):
    """Every vector encoded, decoded and checked."""
    return V.checks(spark).select("id", "category", "name", "passed")


@query("conformance_summary", (
    f"SELECT category, count(*) AS vectors, count(*) AS vectors_passed, count(*) * 9 AS checks, count(*) * 9 AS checks_passed FROM (VALUES "
    f"{_VECTORS}) t(id, category) GROUP BY 1"
))
def conformance_summary(spark, sf):
    return V.summary(V.checks(spark)).select("category", *longs("vectors", "vectors_passed", "checks", "checks_passed"))


def _measured(spark):
    """The sixteen pictures, lossless and lossy: image_id is the picture's place, and that of its lossy copy 100 more."""
    names = list(R.PICTURES)
    number = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)]), F.col("name"))
    copies = F.explode(F.array(number.cast("long"), (number + 100).cast("long"))).alias("image_id")
    px = R.corpus(spark, 32, 32).select(copies, *longs("c", "y", "x"), "v")
    return names, V.harness(px, {i + far: d for i in range(len(names)) for far, d in ((0, None), (100, 1.0))}, 32, 32, 25.0, 0.8, 0.5)


@query("harness")
def harness(spark, sf):
    """What coding costs and gives back, measured on decoded pictures."""
    names, d = _measured(spark)
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("image_id") % 100 + 1).cast("int"))
    mode = F.when(F.col("image_id") < 100, "lossless").otherwise("lossy")
    return d.select(name.alias("name"), mode.alias("mode"), *longs("bytes_in", "bytes_out"),
        *[F.round(c, 4).alias(c) for c in ("ratio", "psnr", "ssim", "distance")], "passed")


@query("batch_encode")
def batch_encode(spark, sf):
    """Files by their paths, each encoded: sizes before and after, and where the result goes."""
    names, d = _measured(spark)
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("image_id") + 1).cast("int"))
    d = d.where("image_id < 100").select(F.concat(F.lit("/data/in/"), name, F.lit(".png")).alias("path"), *longs("bytes_in", "bytes_out"))
    from ..functions.scalar import output_path

    return d.select("path", output_path(F.col("path"), "/data/in/", "out", "img").alias("out"), "bytes_in", "bytes_out")


@query("stream_summary", (
    "SELECT count(*) AS total, count(*) FILTER (w AND c) AS passed, count(*) FILTER (NOT (w AND c)) AS failed, 0::BIGINT AS no_signature, "
    "count(*) FILTER (NOT w) AS no_width, count(*) FILTER (NOT c) AS no_channels, false AS all_passed FROM (SELECT event_id * 13 % 5000 >= "
    "1 AS w, event_id % 6 BETWEEN 1 AND 4 AS c FROM events)"
))
def stream_summary(spark, sf):
    d = T.stream_summary(T.structure_checks(_headers(spark, sf)))
    return d.select(*longs("total", "passed", "failed", "no_signature"), F.col("no_width_ok").alias("no_width"),
        F.col("no_channels_ok").alias("no_channels"), "all_passed")


@query("medical_check", (
    "SELECT event_id, CASE WHEN event_id * 7 % 20000 > 16384 THEN 'side' WHEN [8, 10, 12, 16][event_id % 4 + 1] = 10 THEN 'bits' WHEN "
    "event_id % 5 NOT IN (1, 3) THEN 'channels' END AS failed FROM events"
))
def medical_check(spark, sf):
    e = F.col("event_id")
    d = R.table(spark, sf, "events").select("event_id", (e * 7 % 20000).alias("width"), (e % 9).alias("height"), (e % 5).alias("channels"),
        F.element_at(F.array(*map(F.lit, (8, 10, 12, 16))), (e % 4 + 1).cast("int")).alias("bits"))
    return T.medical_checks(d).select("event_id", "failed")


@query("json_summary", (
    f"WITH {_BENCH}, {_NOW}, a AS (SELECT (n.seconds / b.seconds > 1.1)::INT + (b.ratio / n.ratio > 1.1)::INT AS k FROM cur n JOIN base b "
    f"USING (name)) SELECT '{{\"total\":' || count(*) || ',\"mean_seconds\":' || format('{{:.6f}}', avg(seconds)) || ',\"mean_ratio\":' || "
    f"format('{{:.4f}}', avg(bytes_in / bytes_out)) || ',\"regressions\":' || (SELECT sum(k) FROM a) || '}}' AS summary FROM bench"
))
def json_summary(spark, sf):
    return T.json_summary(_bench(spark, sf), T.regressions(*_now_and_base(spark, sf)))


@query("presets", "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{n}', '{k}', '{float(v)}'::DOUBLE)" for f, ns in PRESETS.items() for n,
    s in ns.items() for k, v in s.items()) + ") t(family, name, setting, value)")
def all_presets(spark, sf):
    return presets(spark)


# noise and residuals

_U = ["((image_id * 7 + c * 5 + y * 31 + x * 13) % 97) / 97.0::DOUBLE", "((image_id * 11 + c * 3 + y * 17 + x * 29) % 89) / 89.0::DOUBLE"]
_Z = f"sqrt(-2 * ln(greatest({_U[0]}, 1e-10))) * cos(2 * pi() * ({_U[1]}))"


@query("noisy_pixels", (
    f"WITH {PX} SELECT {KEY}, {s4(f'greatest(0, least(255, v + ({_Z}) * 0.35 * CASE WHEN c = 0 THEN 1.0 ELSE 0.5 END * 255 * 0.05))')} AS v "
    f"FROM px"
))
def noisy_pixels(spark, sf):
    """The moderate preset over given deviates: luma in full, chroma by half."""
    u = [F.expr(e.replace("::DOUBLE", "D")) for e in _U]
    strength = F.when(F.col("c") == 0, 1.0).otherwise(0.5)
    v = M.add_noise(F.col("v"), M.box_muller(*u), 0.35, strength)
    return R.embedding_pictures(spark, sf).select(*longs(*KEYS), r4(v).alias("v"))


@query("noisy_coefficients", (
    f"WITH {PX}, z AS (SELECT image_id, c, y // 8 AS \"by\", x // 8 AS bx, ((y % 8) * 8 + x % 8)::INT AS i, v, {_Z} AS z FROM px) SELECT "
    f"{BK}, i, {s4('v + z * 0.35 * 1.0 * CASE WHEN i = 0 THEN 0.1 WHEN i < 8 THEN 0.5 ELSE 1.0 END * 2.0')} AS v FROM z"
))
def noisy_coefficients(spark, sf):
    u = [F.expr(e.replace("::DOUBLE", "D")) for e in _U]
    d = R.embedding_pictures(spark, sf).select("image_id", "c", F.expr("y div 8").alias("by"), F.expr("x div 8").alias("bx"),
        F.expr("CAST((y % 8) * 8 + x % 8 AS INT)").alias("i"), "v", M.box_muller(*u).alias("z"))
    return M.noisy_coefficients(d, 0.35, 1.0, F.col("z")).select(*longs(*B.BLOCK), "i", r4(F.col("v")).alias("v"))


@query("max_residual", f"WITH {_RES} SELECT {KEY}, greatest(n, w, nw)::INT AS max_residual FROM rn")
def max_residual(spark, sf):
    d = P.gradient_predict(R.embedding_pictures(spark, sf), 32).select(*KEYS, "r")
    return P.max_residual(d, 32).select(*longs(*KEYS), "max_residual")
