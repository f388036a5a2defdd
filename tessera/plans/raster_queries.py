"""Queries of sources, pointwise and neighbourhood operators, wavelets and blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import blocks as B
from ..operators import colour as C
from ..operators import motion as M
from ..operators import prediction as P
from ..operators import wavelet as W
from ..sources import rasters as R
from .registry import BASIS, BLK, DCT, EV, PX, RGB, longs, query, r4, s4

KEYS = ("image_id", "c", "y", "x")
K = "image_id, c, y, x"
GRID = lambda n=32, c=3: f"(SELECT c, y, x FROM range({c}) a(c), range({n}) b(y), range({n}) d(x))"


@query("px_embed", f"WITH {PX} SELECT {K}, v FROM px")
def px_embed(spark, sf):
    return R.embedding_pictures(spark, sf).select(*longs(*KEYS), "v")


@query("px_events", f"WITH {EV} SELECT {K}, v FROM ev")
def px_events(spark, sf):
    return R.event_frames(spark, sf).select(*longs(*KEYS), "v")


@query("gen_gradient", (
    f"SELECT c, y, x, CAST(CASE c WHEN 0 THEN x * 255 // 31 WHEN 1 THEN y * 255 // 31 WHEN 2 THEN (x + y) * 255 // 62 ELSE 255 END AS INT) "
    f"AS v FROM {GRID(c=4)}"
))
def gen_gradient(spark, sf):
    return R.gradient(spark, 32, 32, 4)


@query("gen_checkerboard", f"SELECT c, y, x, CAST(CASE WHEN (x // 8 + y // 8) % 2 = 0 THEN 255 ELSE 0 END AS INT) AS v FROM {GRID()}")
def gen_checkerboard(spark, sf):
    return R.checkerboard(spark, 32, 32)


@query("gen_solid", f"SELECT c, y, x, CAST(CASE c WHEN 0 THEN 10 WHEN 1 THEN 120 ELSE 250 END AS INT) AS v FROM {GRID()}")
def gen_solid(spark, sf):
    return R.solid(spark, 32, 32, [10, 120, 250])


@query("gen_pattern", f"SELECT c, y, x, CAST(CASE c WHEN 0 THEN x * y % 256 WHEN 1 THEN (x + y) % 256 ELSE xor(x, y) % 256 END AS INT) AS v FROM {GRID()}")
def gen_pattern(spark, sf):
    return R.pattern(spark, 32, 32)


@query("gen_noise")
def gen_noise(spark, sf):
    return R.noise(spark, 32, 32, [42, 43])


_RINGS = "((u - 0.5) * (u - 0.5) + (t - 0.5) * (t - 0.5))"
_SPOT = "((u - 0.3) * (u - 0.3) + (t - 0.6) * (t - 0.6))"
_FACE = "((u - 0.5) * (u - 0.5) / 0.08 + (t - 0.45) * (t - 0.45) / 0.13)"
_LEAF = "(abs(sin(9 * u + 4 * t) + sin(11 * t - 3 * u)) / 2)"
_INK = "(y % 8 < 5 AND (x * 7 + y // 8 * 5 + floor(u * 11) * 11) % 4 <> 0)"
_DOT = "(x % 9 = 4 AND y % 7 = 3)"
_LINE = "(abs(t - 0.5) < 0.02 OR abs(u - 0.5) < 0.02)"
_case = lambda *cases: [f"CASE WHEN {c} THEN {a} ELSE {b} END" for c, a, b in cases]
_PICTURES_SQL = {
    "dusk": ("a", "gradient", ["60 + 140 * t", "70 + 60 * t * (1 - u)", "190 - 120 * t"]),
    "spotlight": ("a", "gradient", [f"230 / (1 + 6 * {_SPOT})", f"210 / (1 + 9 * {_SPOT})", f"160 / (1 + 14 * {_SPOT})"]),
    "tiles": ("a", "edges", [f"{v}[CAST(floor(u * 6) * 2 + floor(t * 6) * 3 AS INT) % 5 + 1]" for v in ([12, 240, 128, 60, 200],
        [200, 30, 128, 90, 220], [90, 60, 10, 180, 30])]),
    "ripples": ("a", "texture", ["127.5 + 100 * sin(20 * u) * cos(14 * t)", "127.5 + 90 * cos(17 * u + 9 * t)", "127.5 + 80 * sin(23 * t)"]),
    "portrait": ("a", "photographic",
        _case(*[(f"{_FACE} < 1", f"{a} - {b} * {_FACE}", f"{c} + {d} * t") for a, b, c,
            d in ((225, 35, 50, 20), (180, 40, 80, 30), (150, 45, 110, 30))])),
    "meadow": ("a", "photographic",
        _case(("t < 0.4", "135", "60 + 25 * sin(31 * u + 47 * t)"), ("t < 0.4", "185 + 40 * t", "130 + 40 * sin(41 * u) * cos(53 * t)"),
            ("t < 0.4", "235", "50"))),
    "window": ("a", "screen", [f"CASE WHEN t < 0.1 THEN {a} WHEN u > 0.6 AND u < 0.9 AND t > 0.8 AND t < 0.92 THEN {b} ELSE {c} END" for a, b,
        c in ((35, 40, 250), (45, 140, 250), (90, 90, 248))]),
    "mixed": ("a", "mixed", [f"CASE WHEN x < 16 THEN {a} WHEN (x // 2 + y // 2) % 2 = 0 THEN 230 ELSE 25 END" for a in ("255 * t", "510 * u", "90")]),
    "bars": ("b", "synthetic", [f"{v}[CAST(floor(u * 7) AS INT) + 1]" for v in ([200, 30, 30, 200, 90, 240, 10], [40, 180, 60, 190, 90, 240, 10],
        [50, 70, 200, 40, 90, 240, 10])]),
    "rings": ("b", "synthetic", [f"127.5 + 120 * cos(180 * {_RINGS})"] * 3),
    "shallow": ("b", "gradient", ["100 + 8 * u", "104 + 8 * t", "108 + 4 * (u + t)"]),
    "dots": ("b", "edges", _case((_DOT, "255", "0")) * 3),
    "diagram": ("c", "diagram", [(
        f"CASE WHEN {_LINE} THEN 30 WHEN greatest(u, t) < 0.35 AND least(u, t) > 0.1 THEN {a} WHEN greatest(u, t) < 0.9 AND least(u, t) > "
        f"0.65 THEN {b} ELSE 255 END"
    ) for a, b in ((90, 220), (160, 150), (220, 80))]),
    "leaf": ("c", "nature", [f"{a} + {b} * {_LEAF}" for a, b in ((30, 60), (90, 120), (20, 40))]),
    "poster": ("c", "illustration",
        [f"CASE WHEN {_RINGS} < 0.09 THEN {a} WHEN t > 0.5 + abs(u - 0.5) THEN {b} ELSE {c} END" for a, b,
            c in ((230, 40, 245), (70, 90, 220), (60, 160, 150))]),
    "letters": ("c", "text", _case((_INK, "20", "245"), (_INK, "20", "245"), (_INK, "25", "240"))),
}
_PLACES = f"(SELECT c, y, x, (x + 0.5::DOUBLE) / 32 AS u, (y + 0.5::DOUBLE) / 32 AS t FROM {GRID()})"


@query("corpus_pictures", " UNION ALL ".join(
    (
        f"SELECT '{s}' AS \"set\", '{n}' AS name, '{cat}' AS category, c, y, x, CAST(floor(CASE c WHEN 0 THEN {a} WHEN 1 THEN {b} ELSE {d} "
        f"END) AS INT) AS v FROM {_PLACES}"
    )
    for n, (s, cat, (a, b, d)) in _PICTURES_SQL.items()
))
def corpus_pictures(spark, sf):
    """All sixteen pictures of the three sets."""
    return R.corpus(spark, 32, 32)


@query("list_files")
def list_files(spark, sf):
    return R.list_files(spark, sf, "*.parquet").select(F.regexp_replace("path", "^.*/", "").alias("file"), "length")


@query("output_path", "SELECT doc_id, 'out/' || source || '/' || doc_id || '.v1.img' AS path FROM documents")
def output_path(spark, sf):
    path = F.concat(F.lit("/data/in/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".v1.png"))
    return R.table(spark, sf, "documents").select("doc_id", S.output_path(path, "/data/in/", "out", "img").alias("path"))


@query("format_of_extension", (
    "SELECT event_id, CASE lower(substr('PNG tif TIFFbmp gif ', CAST(event_id % 5 * 4 + 1 AS INT), 4)) WHEN 'png ' THEN 'png' WHEN 'tif ' "
    "THEN 'tiff' WHEN 'tiff' THEN 'tiff' WHEN 'bmp ' THEN 'bmp' END AS format FROM events"
))
def format_of_extension(spark, sf):
    ext = F.element_at(F.array(*map(F.lit, ("PNG", "tif", "TIFF", "bmp", "gif"))), (F.col("event_id") % 5 + 1).cast("int"))
    return R.table(spark, sf, "events").select("event_id", S.format_of_extension(ext).alias("format"))


# pointwise


@query("channel", f"WITH {PX} SELECT image_id, y, x, v FROM px WHERE c = 1")
def channel(spark, sf):
    return R.embedding_pictures(spark, sf).where("c = 1").select(*longs("image_id", "y", "x"), "v")


_RCT = f"""{PX}, {RGB}, f1 AS (SELECT *, r - b AS co FROM rgb), f2 AS (SELECT *, b + (co >> 1) AS t FROM f1), f3 AS (SELECT *, g - t AS cg FROM f2),
  rct AS (SELECT image_id, y, x, t + (cg >> 1) AS yy, co, cg FROM f3)"""


@query("rct_forward", (
    f"WITH {_RCT} SELECT image_id, 0::BIGINT AS c, y, x, yy::INT AS v FROM rct UNION ALL SELECT image_id, 1, y, x, co::INT FROM rct UNION "
    f"ALL SELECT image_id, 2, y, x, cg::INT FROM rct"
))
def rct_forward(spark, sf):
    return C.rct_forward(R.embedding_pictures(spark, sf)).select(*longs(*KEYS), F.col("v").cast("int").alias("v"))


@query("rct_round_trip", f"WITH {PX} SELECT {K}, v FROM px")
def rct_round_trip(spark, sf):
    return C.rct_inverse(C.rct_forward(R.embedding_pictures(spark, sf))).select(*longs(*KEYS), F.col("v").cast("int").alias("v"))


_YCC = ["0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b", "-0.168736::DOUBLE * r - 0.331264::DOUBLE * g + 0.5::DOUBLE * b + 128",
    "0.5::DOUBLE * r - 0.418688::DOUBLE * g - 0.081312::DOUBLE * b + 128"]
_three = lambda es, src, wrap=s4: " UNION ALL ".join(f"SELECT image_id, {i}::BIGINT AS c, y, x, {wrap(e)} AS v FROM {src}" for i,
    e in enumerate(es))


@query("ycbcr_forward", f"WITH {PX}, {RGB} {_three(_YCC, 'rgb')}")
def ycbcr_forward(spark, sf):
    return C.ycbcr_forward(R.embedding_pictures(spark, sf)).select(*longs(*KEYS), r4(F.col("v")).alias("v"))


@query("ycbcr_integers", f"WITH {PX}, {RGB} {_three(_YCC, 'rgb', lambda e: f'CAST(floor(greatest(0, least(255, {e}))) AS INT)')}")
def ycbcr_integers(spark, sf):
    return C.ycbcr_integers(R.embedding_pictures(spark, sf)).select(*longs(*KEYS), "v")


@query("ycbcr_round_trip", f"WITH {PX} SELECT {K}, v FROM px")
def ycbcr_round_trip(spark, sf):
    return C.ycbcr_inverse(C.ycbcr_forward(R.embedding_pictures(spark, sf))).select(*longs(*KEYS), F.round("v").cast("int").alias("v"))


_LMS = [(
    f"cbrt(greatest(0, {a}::DOUBLE * r / 255 + {b}::DOUBLE * g / 255 + {c}::DOUBLE * b / 255) + 0.00379246::DOUBLE) - "
    f"cbrt(0.00379246::DOUBLE)"
) for a, b, c in C.ABSORBANCE]


@query("xyb_forward", (
    f"WITH {PX}, {RGB}, lms AS (SELECT image_id, y, x, {_LMS[0]} AS l, {_LMS[1]} AS m, {_LMS[2]} AS s FROM rgb) "
    f"{_three(['(l - m) * 0.5', '(l + m) * 0.5', 's'], 'lms')}"
))
def xyb_forward(spark, sf):
    return C.xyb_forward(R.embedding_pictures(spark, sf)).select(*longs(*KEYS), r4(F.col("v")).alias("v"))


@query("xyb_round_trip", f"WITH {PX} SELECT {K}, v FROM px")
def xyb_round_trip(spark, sf):
    return C.xyb_inverse(C.xyb_forward(R.embedding_pictures(spark, sf))).select(*longs(*KEYS), F.round("v").cast("int").alias("v"))


_O = {k: f"pow({k} / 255.0::DOUBLE, 1.0::DOUBLE / 3.0::DOUBLE)" for k in "rgb"}


@query("opponent", (
    f"WITH {PX}, {RGB} "
    f"{_three([f'{_O["r"]} - {_O["g"]}', f'({_O["r"]} + {_O["g"]}) / 2', f'{_O["b"]} - ({_O["r"]} + {_O["g"]}) / 2'], 'rgb')}"
))
def opponent(spark, sf):
    return C.opponent(R.embedding_pictures(spark, sf)).select(*longs(*KEYS), r4(F.col("v")).alias("v"))


@query("distance_of_quality", (
    f"SELECT q, {s4('CASE WHEN q >= 100 THEN 0 WHEN q >= 30 THEN 0.1 + (100 - q) / 10.0 ELSE 7 + (30 - q) / 3.75 END')} AS distance FROM "
    f"range(101) t(q)"
))
def distance_of_quality(spark, sf):
    return spark.range(101).select(F.col("id").alias("q"), r4(S.distance_of_quality(F.col("id"))).alias("distance"))


_ROI = """SELECT y, x, CASE WHEN x < 4 OR x >= 28 OR y < 4 OR y >= 28 THEN 1.0 WHEN dx = 0 AND dy = 0 THEN 1 / 1.2 ELSE 1 / 1.2 + (1 - 1 / 1.2) * (1 - cos(least(1.0, sqrt(dx * dx + dy * dy) / 4) * pi())) / 2 END AS m
  FROM (SELECT y, x, CASE WHEN x < 8 THEN 8 - x WHEN x >= 24 THEN x - 23 ELSE 0 END AS dx, CASE WHEN y < 8 THEN 8 - y WHEN y >= 24 THEN y - 23 ELSE 0 END AS dy FROM range(32) a(y), range(32) b(x))"""


@query("roi_distance", f"SELECT y, x, {s4('m')} AS m FROM ({_ROI})")
def roi_distance(spark, sf):
    return R.grid(spark, 32, 32, 1).select("y", "x", r4(S.roi_multiplier(F.col("x"), F.col("y"), 8, 8, 16, 16, 20.0, 4)).alias("m"))


@query("block_distance", (
    f"SELECT \"by\", bx, {s4('1.1 * m')} AS distance FROM ({_ROI}) JOIN (SELECT \"by\", bx FROM range(4) a(\"by\"), range(4) b(bx)) ON y = "
    f"\"by\" * 8 + 4 AND x = bx * 8 + 4"
))
def block_distance(spark, sf):
    d = R.grid(spark, 4, 4, 1).select(F.col("y").alias("by"), F.col("x").alias("bx"))
    return d.select("by", "bx", r4(1.1 * S.roi_multiplier(F.col("bx") * 8 + 4, F.col("by") * 8 + 4, 8, 8, 16, 16, 20.0, 4)).alias("distance"))


@query("signed_map", (
    f"WITH {EV} SELECT {K}, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END::BIGINT AS u, d::BIGINT AS back FROM (SELECT {K}, v - 60 AS d "
    f"FROM ev)"
))
def signed_map(spark, sf):
    d = R.event_frames(spark, sf).withColumn("u", S.fold_sign(F.col("v") - 60))
    return d.select(*longs(*KEYS, "u"), S.unfold_sign(F.col("u")).cast("long").alias("back"))


@query("sample_types", (
    f"WITH {PX} SELECT {K}, {s4('v / 255.0')} AS as_u8, {s4('v * 257 / 65535.0')} AS as_u16, "
    f"{s4('CASE WHEN v >= 128 THEN (v - 256) / 32768.0 ELSE v / 32767.0 END')} AS as_i16, CAST(floor(v / 255.0::DOUBLE * 65535.0::DOUBLE + "
    f"0.25) AS INT) AS stored FROM px"
))
def sample_types(spark, sf):
    v = F.col("v")
    n = lambda x, k: r4(S.normalise_sample(x, F.lit(k)))
    return R.embedding_pictures(spark, sf).select(*longs(*KEYS), n(v, "uint8").alias("as_u8"), n(v * 257, "uint16").alias("as_u16"),
        n(F.when(v >= 128, v - 256).otherwise(v), "int16").alias("as_i16"), F.floor(v / 255.0 * 65535.0 + 0.25).cast("int").alias("stored"))


@query("reinterpret_int16", f"WITH {PX} SELECT {K}, CASE WHEN v * 257 >= 32768 THEN v * 257 - 65536 ELSE v * 257 END::INT AS v FROM px")
def reinterpret_int16(spark, sf):
    return R.embedding_pictures(spark, sf).select(*longs(*KEYS), S.reinterpret_int16(F.col("v") * 257).cast("int").alias("v"))


@query("extra_channel", f"WITH {PX} SELECT image_id, y, x, CAST(v * 65535 // 255 AS INT) AS depth FROM px WHERE c = 2")
def extra_channel(spark, sf):
    return R.embedding_pictures(spark, sf).where("c = 2").select(*longs("image_id", "y", "x"),
        F.expr("CAST(v * 65535 div 255 AS INT)").alias("depth"))


@query("vector_math", (
    "SELECT vec_id, list_transform(e, lambda x: round(x + x * 2, 4)) AS added, list_transform(e, lambda x: round(greatest(-0.25, "
    "least(0.25, x)), 4)) AS clamped, list_transform(e, lambda x: round(abs(x), 4)) AS sizes FROM (SELECT vec_id, "
    "list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 100) AS DOUBLE) / 100 + 0.0) AS e FROM embeddings)"
))
def vector_math(spark, sf):
    d = R.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 100) / 100 + 0.0).alias("e"))
    return d.select("vec_id", F.transform(F.zip_with("e", F.transform("e", lambda x: x * 2), lambda a, b: a + b),
        lambda x: F.round(x, 4)).alias("added"), F.transform("e", lambda x: F.round(S.clamp(x, -0.25, 0.25), 4)).alias("clamped"),
            F.transform("e", lambda x: F.round(F.abs(x), 4)).alias("sizes"))


@query("resize_nearest", (
    f"WITH {PX} SELECT px.image_id, px.c, ty AS y, tx AS x, v FROM px JOIN range(20) a(ty) ON px.y = least(ty * 32 // 20, 31) JOIN "
    f"range(48) b(tx) ON px.x = least(tx * 32 // 48, 31)"
))
def resize_nearest(spark, sf):
    from ..operators.metrics import resize_nearest as resize

    return resize(R.embedding_pictures(spark, sf), 32, 32, 48, 20).select(*longs(*KEYS), "v")


# neighbours

_N = f"""SELECT p.*, n.v AS n, w.v AS w, nw.v AS nw, ne.v AS ne FROM px p LEFT JOIN px n ON n.image_id = p.image_id AND n.c = p.c AND n.y = p.y - 1 AND n.x = p.x
  LEFT JOIN px w ON w.image_id = p.image_id AND w.c = p.c AND w.y = p.y AND w.x = p.x - 1 LEFT JOIN px nw ON nw.image_id = p.image_id AND nw.c = p.c AND nw.y = p.y - 1 AND nw.x = p.x - 1
  LEFT JOIN px ne ON ne.image_id = p.image_id AND ne.c = p.c AND ne.y = p.y - 1 AND ne.x = p.x + 1"""
_NEAR = f"{PX}, near AS ({_N})"
_GRAD = (
    f"{_NEAR}, grad AS (SELECT {K}, v, CASE WHEN n IS NULL AND w IS NULL THEN 0 WHEN n IS NULL THEN w WHEN w IS NULL THEN n ELSE "
    f"greatest(0, least(65535, n + w - nw)) END AS p FROM near)"
)


@query("gradient_residual", f"WITH {_GRAD} SELECT {K}, p::INT AS p, (v - p)::INT AS r FROM grad")
def gradient_residual(spark, sf):
    return P.gradient_predict(R.embedding_pictures(spark, sf), 32).select(*longs(*KEYS), "p", F.col("r").cast("int").alias("r"))


_Z = f"{_NEAR}, z AS (SELECT {K}, v, coalesce(n, 0) AS n, coalesce(w, 0) AS w, coalesce(nw, 0) AS nw FROM near)"
_PRED = {"zero": "0", "west": "w", "north": "n", "average_wn": "(w + n) // 2", "gradient": "greatest(0, least(65535, n + w - nw))",
    "select": "CASE WHEN abs(n - nw) < abs(w - nw) THEN w ELSE n END", "average_wnw": "(w + nw) // 2", "average_nnw": "(n + nw) // 2"}


@query("predictors", f"WITH {_Z} SELECT {K}, " + ", ".join(f'CASE WHEN x = 0 AND y = 0 THEN 0 ELSE {e} END::INT AS "{k}"' for k,
    e in _PRED.items()) + " FROM z")
def predictors(spark, sf):
    d = P.all_predictors(R.embedding_pictures(spark, sf), 32)
    return d.select(*longs(*KEYS), *_PRED)


_PROPS = f"""{_NEAR}, pr AS (SELECT {K}, v, coalesce(n, w, 0) AS pn, coalesce(w, n, 0) AS pw, CASE WHEN n IS NOT NULL AND w IS NOT NULL THEN nw ELSE coalesce(n, w, 0) END AS pnw,
  CASE WHEN n IS NOT NULL THEN coalesce(ne, n) ELSE coalesce(n, w, 0) END AS pne, coalesce(n, 0) AS n, coalesce(w, 0) AS w, coalesce(nw, 0) AS nw FROM near)"""


@query("tree_properties", (
    f"WITH {_PROPS} SELECT {K}, c AS channel, pn::INT AS north, pw::INT AS west, pnw::INT AS north_west, abs(pw - pnw)::INT AS gradient_h, "
    f"abs(pn - pnw)::INT AS gradient_v, (pw - pnw)::INT AS w_nw, (pn - pnw)::INT AS n_nw, (pn - pne)::INT AS n_ne FROM pr"
))
def tree_properties(spark, sf):
    """Nine of the ten; the tenth looks at residuals, see max_residual."""
    d = P.properties(R.embedding_pictures(spark, sf), 32)
    whole = lambda c, name: F.col(c).cast("int").alias(name)
    values = [whole("n", "north"), whole("w", "west"), whole("nw", "north_west")]
    return d.select(*longs(*KEYS), F.col("c").cast("long").alias("channel"), *values,
        *[whole(k, k) for k in ("gradient_h", "gradient_v", "w_nw", "n_nw", "n_ne")])


_TREE = f"""{_PROPS}, tr AS (SELECT *, CASE WHEN abs(pw - pnw) <= 16 THEN CASE WHEN abs(pn - pnw) <= 16 THEN 0 ELSE 1 END ELSE CASE WHEN abs(pn - pnw) <= 16 THEN 2 ELSE 3 END END AS context FROM pr),
  tp AS (SELECT {K}, v, context, CASE WHEN x = 0 AND y = 0 THEN 0 ELSE CASE context WHEN 0 THEN {_PRED['gradient']} WHEN 1 THEN w WHEN 2 THEN n ELSE {_PRED['select']} END END AS p FROM tr)"""


@query("tree_residual", f"WITH {_TREE} SELECT {K}, context::INT AS context, (v - p)::INT AS r FROM tp")
def tree_residual(spark, sf):
    return P.tree_predict(R.embedding_pictures(spark, sf), 32).select(*longs(*KEYS), F.col("context").cast("int").alias("context"),
        F.col("r").cast("int").alias("r"))


@query("extended_tree_round_trip", f"WITH {PX} SELECT {K}, v FROM px")
def extended_tree_round_trip(spark, sf):
    return _extended(R.embedding_pictures(spark, sf))


def _extended(px):
    return P.extended_rebuild(P.extended_residuals(px, 32, 32), 32, 32).select(*longs(*KEYS), F.col("v").cast("int").alias("v"))


_RES = f"""{_GRAD}, res AS (SELECT {K}, v - p AS r, abs(v - p) AS a FROM grad), rn AS (SELECT p.image_id, p.c, p.y, p.x, p.r, coalesce(n.a, 0) AS n, coalesce(w.a, 0) AS w, coalesce(nw.a, 0) AS nw FROM res p
  LEFT JOIN res n ON n.image_id = p.image_id AND n.c = p.c AND n.y = p.y - 1 AND n.x = p.x LEFT JOIN res w ON w.image_id = p.image_id AND w.c = p.c AND w.y = p.y AND w.x = p.x - 1
  LEFT JOIN res nw ON nw.image_id = p.image_id AND nw.c = p.c AND nw.y = p.y - 1 AND nw.x = p.x - 1),
  rc AS (SELECT {K}, r, CASE WHEN (n + w + nw) // 3 = 0 THEN 0 WHEN (n + w + nw) // 3 < 16 THEN 1 WHEN (n + w + nw) // 3 < 256 THEN 2 ELSE 3 END * 2 + CASE WHEN n > w THEN 1 ELSE 0 END AS context FROM rn)"""


@query("residual_context", f"WITH {_RES} SELECT {K}, r::INT AS r, context::INT AS context FROM rc")
def residual_context(spark, sf):
    d = P.gradient_predict(R.embedding_pictures(spark, sf), 32).select(*KEYS, "r")
    return P.residual_contexts(d, 32).select(*longs(*KEYS), F.col("r").cast("int").alias("r"), "context")


@query("rice_parameters", (
    f"WITH {_RES}, t AS (SELECT context, count(*) AS n, sum(CASE WHEN r >= 0 THEN 2 * r ELSE -2 * r - 1 END) AS total FROM rc GROUP BY 1) "
    f"SELECT context::INT AS context, n, total::BIGINT AS total, CASE WHEN total // n = 0 THEN 0 ELSE length(to_binary((total // "
    f"n)::BIGINT)) - 1 END::INT AS k FROM t"
).replace("length(to_binary((total // n)::BIGINT)) - 1", "floor(log2((total // n)::DOUBLE))"))
def rice_parameters(spark, sf):
    d = P.gradient_predict(R.embedding_pictures(spark, sf), 32).select(*KEYS, "r")
    return P.rice_parameters(P.residual_contexts(d, 32)).select("context", "n", "total", "k")


_RUN = f"""WITH {EV}, s AS (SELECT *, y * 16 + x AS pos, v // 32 AS k FROM ev), f AS (SELECT *, CASE WHEN lag(k) OVER w IS DISTINCT FROM k THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY image_id ORDER BY pos)),
  g AS (SELECT *, sum(new) OVER (PARTITION BY image_id ORDER BY pos) AS island FROM f)"""


@query("runs", f"{_RUN} SELECT image_id, c, k::INT AS k, min(pos) AS start, count(*) AS length FROM g GROUP BY image_id, c, k, island")
def runs(spark, sf):
    d = R.event_frames(spark, sf).withColumn("k", F.expr("v div 32"))
    return P.runs(d, 16, "k").select(*longs("image_id", "c"), F.col("k").cast("int").alias("k"), *longs("start", "length"))


@query("runs_by_context", _RUN.replace("lag(k) OVER w IS DISTINCT FROM k",
    "lag(k) OVER w IS DISTINCT FROM k OR lag(y // 8) OVER w IS DISTINCT FROM y // 8") + (
    " SELECT image_id, c, k::INT AS k, (y // 8)::INT AS context, min(pos) AS start, count(*) AS length FROM g GROUP BY image_id, c, k, y "
    "// 8, island"
))
def runs_by_context(spark, sf):
    d = R.event_frames(spark, sf).withColumn("k", F.expr("CAST(v div 32 AS INT)")).withColumn("context", F.expr("CAST(y div 8 AS INT)"))
    return P.runs(d, 16, "k", "context").select(*longs("image_id", "c"), "k", "context", *longs("start", "length"))


@query("run_expansion", f"WITH {EV} SELECT {K}, (v // 32)::INT AS k FROM ev")
def run_expansion(spark, sf):
    d = R.event_frames(spark, sf).withColumn("k", F.expr("CAST(v div 32 AS INT)"))
    return P.expand_runs(P.runs(d, 16, "k"), 16, "k").select(*longs(*KEYS), "k")


@query("keyframes", f"WITH {EV} SELECT DISTINCT image_id AS frame_id, image_id % 4 = 0 AS is_key, image_id - image_id % 4 AS key_id FROM ev")
def keyframes(spark, sf):
    frames = R.event_frames(spark, sf).select(F.col("image_id").alias("frame_id"))
    return P.keyframes(frames, 10, 3).select(*longs("frame_id"), "is_key", "key_id")


@query("frame_offsets", (
    f"WITH {EV}, f AS (SELECT DISTINCT image_id AS frame_id FROM ev), d AS (SELECT frame_id, CASE WHEN frame_id < 3 THEN [5, 7, 9][frame_id "
    f"+ 1] ELSE 33 END::BIGINT AS duration FROM f) SELECT frame_id, duration, coalesce(sum(duration) OVER (ORDER BY frame_id ROWS BETWEEN "
    f"UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d"
))
def frame_offsets(spark, sf):
    frames = R.event_frames(spark, sf).select(F.col("image_id").alias("frame_id"))
    return M.durations(frames, [5, 7, 9]).select(*longs("frame_id", "duration", "start"))


# wavelets


def _pair_sql(axis: str, src: str, half: int) -> str:
    other = [k for k in KEYS if k != axis]
    o = ", ".join(other)
    return f"""(SELECT {o}, {axis} // 2 AS {axis}, CASE WHEN count(*) = 2 THEN sum(v) >> 1 ELSE sum(v) END AS v FROM (SELECT {o}, {axis}, v::BIGINT AS v FROM {src}) GROUP BY {o}, {axis} // 2
      UNION ALL SELECT {o}, {axis} // 2 + {half}, sum(CASE WHEN {axis} % 2 = 0 THEN v ELSE -v END) FROM (SELECT {o}, {axis}, v::BIGINT AS v FROM {src}) GROUP BY {o}, {axis} // 2)"""


def _step_sql(name: str, src: str, axis: str, w: int, h: int) -> str:
    size = w if axis == "x" else h
    return (
        f"{name}i AS MATERIALIZED (SELECT * FROM {src} WHERE x < {w} AND y < {h}), {name} AS MATERIALIZED (SELECT {K}, v::BIGINT AS v FROM "
        f"{_pair_sql(axis, name + 'i', (size + 1) // 2)} UNION ALL SELECT {K}, v::BIGINT FROM {src} WHERE NOT (x < {w} AND y < {h}))"
    )


_SHIFT = "px0 AS (SELECT image_id, c, y, x, (v - 128)::BIGINT AS v FROM px)"


def _shifted(spark, sf):
    return R.embedding_pictures(spark, sf).withColumn("v", F.col("v") - 128)


for _axis in ("x", "y"):

    @query(f"squeeze_{_axis}", f"WITH {PX}, {_SHIFT}, {_step_sql('s1', 'px0', _axis, 32, 32)} SELECT {K}, v::INT AS v FROM s1")
    def squeeze(spark, sf, axis=_axis):
        return W.step(_shifted(spark, sf), axis, 32, 32).select(*longs(*KEYS), "v")


_STEPS = ", ".join(_step_sql(f"s{i + 1}", f"s{i}" if i else "px0", *s) for i, s in enumerate(W.step_plan(32, 32, 3)))


@query("squeeze_three_levels", f"WITH {PX}, {_SHIFT}, {_STEPS} SELECT {K}, v::INT AS v FROM s6")
def squeeze_three_levels(spark, sf):
    return W.forward(_shifted(spark, sf), 32, 32, 3).select(*longs(*KEYS), "v")


@query("squeeze_round_trip", f"WITH {PX} SELECT {K}, v FROM px")
def squeeze_round_trip(spark, sf):
    d = W.inverse(W.forward(_shifted(spark, sf), 32, 32, 3), 32, 32, 3)
    return d.select(*longs(*KEYS), (F.col("v") + 128).alias("v"))


# blocks

BK = 'image_id, c, "by", bx'
BKEYS = ("image_id", "c", "by", "bx")


def _blocks(spark, sf):
    return B.extract(R.embedding_pictures(spark, sf))


def _long(d, column, value=r4, name="v"):
    return d.select(*longs(*BKEYS), F.posexplode(column).alias("i", name)).select(*BKEYS, F.col("i").cast("int").alias("i"),
        value(F.col(name)).alias(name))


@query("block_extract", f"WITH {PX}, {BLK} SELECT {BK}, (j * 8 + i)::INT AS i, v FROM blk")
def block_extract(spark, sf):
    return _long(_blocks(spark, sf), "coef", lambda v: v)


@query("block_extract_padded", (
    f"WITH {PX}, p AS (SELECT * FROM px WHERE x < 28 AND y < 30) SELECT image_id, c, ty // 8 AS by, tx // 8 AS bx, ((ty % 8) * 8 + tx % "
    f"8)::INT AS i, v::DOUBLE AS v FROM p JOIN range(32) a(ty) ON p.y = least(ty, 29) JOIN range(32) b(tx) ON p.x = least(tx, 27)"
))
def block_extract_padded(spark, sf):
    return _long(B.extract(R.embedding_pictures(spark, sf).where("x < 28 AND y < 30"), 8, 8, 28, 30), "coef", lambda v: v)


@query("block_place", f"WITH {PX} SELECT {K}, v FROM px WHERE x < 30 AND y < 29")
def block_place(spark, sf):
    px = R.embedding_pictures(spark, sf).where("x < 30 AND y < 29")
    return B.place(B.extract(px, 16, 8, 30, 29), 16, 8, 30, 29).select(*longs(*KEYS), F.col("v").cast("int").alias("v"))


@query("dct8", f"WITH {PX}, {BLK}, {BASIS}, {DCT} SELECT {BK}, (w * 8 + u)::INT AS i, {s4('v')} AS v FROM dct")
def dct8(spark, sf):
    return _long(B.dct(_blocks(spark, sf)), "coef")


@query("idct8", f"WITH {PX} SELECT {K}, v FROM px")
def idct8(spark, sf):
    return B.place(B.idct(B.dct(_blocks(spark, sf)))).select(*longs(*KEYS), F.round("v").cast("int").alias("v"))


_B16 = (
    "b16 AS (SELECT k, i, CASE WHEN k = 0 THEN sqrt(1.0 / 16) ELSE sqrt(2.0 / 16) END * cos((2 * i + 1) * k * pi() / 32) AS b FROM "
    "range(16) t(k), range(16) s(i))"
)


@query("dct_variable", f"""WITH {PX}, {BASIS}, {_B16}, blk AS (SELECT image_id, c, y // 8 AS by, x // 16 AS bx, y % 8 AS j, x % 16 AS i, v::DOUBLE AS v FROM px),
  h AS (SELECT {BK}, j, k AS u, sum(blk.v * b) AS v FROM blk JOIN b16 USING (i) GROUP BY ALL), d AS (SELECT {BK}, k AS w, u, sum(h.v * b) AS v FROM h JOIN (SELECT k, i AS j, b FROM basis) USING (j) GROUP BY ALL)
  SELECT {BK}, (w * 16 + u)::INT AS i, {s4('v')} AS v FROM d""")
def dct_variable(spark, sf):
    return _long(B.dct(B.extract(R.embedding_pictures(spark, sf), 16, 8), 16, 8), "coef")


_ACT = (
    f"{PX}, {BLK}, act AS (SELECT {BK}, greatest(0, avg(v * v) - avg(v) * avg(v)) AS a FROM blk GROUP BY ALL), sc AS (SELECT {BK}, a, 1 + "
    f"(a / (a + 0.01) - 0.5) AS s FROM act)"
)


def _scaled(spark, sf):
    d = _blocks(spark, sf).withColumn("a", B.activity(F.col("coef"))).withColumn("scale", B.adaptive_scale(F.col("a")))
    return d


@query("block_activity", f"WITH {_ACT} SELECT {BK}, {s4('a')} AS activity, {s4('s')} AS scale FROM sc")
def block_activity(spark, sf):
    return _scaled(spark, sf).select(*longs(*BKEYS), r4(F.col("a")).alias("activity"), r4(F.col("scale")).alias("scale"))


_STEP = lambda s, d=1.1: f"greatest(1, 8 * {d}) * (1 + 0.5 * (u + w)) * greatest(0.5, least(2.0, 1 / {s})) * CASE WHEN c > 0 THEN 1.5 ELSE 1 END"


@query("quant_matrix", f"SELECT c, (w * 8 + u)::INT AS i, {s4(_STEP('1.5'))} AS step FROM range(3) a(c), range(8) b(w), range(8) d(u)")
def quant_matrix(spark, sf):
    d = spark.range(192).select(F.expr("id div 64").alias("c"), (F.col("id") % 64).cast("int").alias("i"))
    return d.select("c", "i", r4(B.quant_step(F.col("c"), F.col("i"), 1.1, F.lit(1.5))).alias("step"))


_Q = (
    f"{_ACT}, {BASIS}, {DCT}, q AS (SELECT {BK}, w, u, v, s, CAST(greatest(-32768, least(32767, round(v / ({_STEP('s')})))) AS INT) AS q "
    f"FROM dct JOIN sc USING ({BK}))"
)


def _quantised(spark, sf, distance=1.1):
    return B.quantise(B.dct(_scaled(spark, sf)), distance)


@query("quantise", f"WITH {_Q} SELECT {BK}, (w * 8 + u)::INT AS i, q FROM q")
def quantise(spark, sf):
    return _long(_quantised(spark, sf), "q", lambda v: v, "q")


@query("dequantise", f"WITH {_Q} SELECT {BK}, (w * 8 + u)::INT AS i, {s4(f'q * ({_STEP("s")})')} AS v FROM q")
def dequantise(spark, sf):
    return _long(B.dequantise(_quantised(spark, sf), 1.1), "coef")


_ZIG = "CASE WHEN (w + u) % 2 = 1 THEN w ELSE u END"
_SCAN = (
    f"{_Q}, zz AS (SELECT w, u, row_number() OVER (ORDER BY w + u, {_ZIG}) - 1 AS k FROM range(8) a(w), range(8) b(u)), sq AS (SELECT {BK}, "
    f"k, q FROM q JOIN zz USING (w, u))"
)


def _scanned(spark, sf):
    return _quantised(spark, sf).withColumn("s", B.scan("q", B.zigzag_order()))


@query("zigzag", f"WITH {_SCAN} SELECT {BK}, k::INT AS i, q FROM sq")
def zigzag(spark, sf):
    return _long(_scanned(spark, sf), "s", lambda v: v, "q")


@query("zigzag_round_trip", f"WITH {_Q} SELECT {BK}, (w * 8 + u)::INT AS i, q FROM q")
def zigzag_round_trip(spark, sf):
    return _long(_scanned(spark, sf).withColumn("q", B.unscan("s", B.zigzag_order())), "q", lambda v: v, "q")


@query("natural_order", "SELECT (row_number() OVER (ORDER BY r * r + c * c, r, c) - 1)::INT AS k, (r * 8 + c)::INT AS i FROM range(8) a(r), range(8) b(c)")
def natural_order(spark, sf):
    return spark.createDataFrame(list(enumerate(B.natural_order())), "k int, i int")


@query("ac_zero_runs", (
    f"WITH {_SCAN}, f AS (SELECT {BK}, k, q FROM sq WHERE k > 0 AND q <> 0) SELECT {BK}, k::INT AS k, q, (k - coalesce(lag(k) OVER "
    f"(PARTITION BY {BK} ORDER BY k), 0) - 1)::INT AS zeros FROM f UNION ALL SELECT {BK}, 64, NULL, (63 - l)::INT FROM (SELECT {BK}, "
    f"coalesce(max(k) FILTER (k > 0 AND q <> 0), 0) AS l FROM sq GROUP BY {BK}) WHERE l < 63"
))
def ac_zero_runs(spark, sf):
    d = _scanned(spark, sf).select(*BKEYS, F.posexplode("s").alias("k", "q"))
    return P.zero_runs(d, *BKEYS).select(*longs(*BKEYS), "k", "q", "zeros")


@query("dc_prediction", f"""WITH {_Q}, dc AS (SELECT {BK}, q AS dc FROM q WHERE w = 0 AND u = 0), n AS (SELECT a.*, l.dc AS l, t.dc AS t FROM dc a LEFT JOIN dc l ON l.image_id = a.image_id AND l.c = a.c AND l.by = a.by AND l.bx = a.bx - 1
  LEFT JOIN dc t ON t.image_id = a.image_id AND t.c = a.c AND t.by = a.by - 1 AND t.bx = a.bx)
  SELECT {BK}, dc::INT AS dc, (dc - CASE WHEN l IS NOT NULL AND t IS NOT NULL THEN trunc((l + t) / 2.0) ELSE coalesce(l, t, 0) END)::INT AS residual FROM n""")
def dc_prediction(spark, sf):
    d = _quantised(spark, sf).select(*BKEYS, F.get("q", F.lit(0)).alias("dc"))
    return P.dc_residuals(d).select(*longs(*BKEYS), F.col("dc").cast("int").alias("dc"), F.col("residual").cast("int").alias("residual"))


_CFL = f"""{PX}, {BLK}, {BASIS}, {DCT}, ac AS (SELECT c.image_id, c.c, c.by, c.bx, c.w, c.u, l.v AS l, c.v AS v FROM dct c JOIN dct l ON l.c = 0 AND c.c > 0 AND l.image_id = c.image_id AND l.by = c.by AND l.bx = c.bx AND l.w = c.w AND l.u = c.u),
  fa AS (SELECT {BK}, CASE WHEN sum(l * l) <= 1e-10 THEN 0 ELSE sum(l * v) / sum(l * l) END AS f FROM ac WHERE w + u > 0 GROUP BY ALL)"""


@query("chroma_factor", f"WITH {_CFL} SELECT {BK}, {s4('f')} AS factor FROM fa")
def chroma_factor(spark, sf):
    return B.chroma_factor(B.dct(_blocks(spark, sf))).select(*longs(*BKEYS), r4(F.col("factor")).alias("factor"))


@query("chroma_residual", (
    f"WITH {_CFL} SELECT {BK}, (w * 8 + u)::INT AS i, {s4('CASE WHEN w + u = 0 THEN v ELSE v - f * l END')} AS v FROM ac JOIN fa USING "
    f"({BK})"
))
def chroma_residual(spark, sf):
    return _long(B.chroma_factor(B.dct(_blocks(spark, sf))), "residual")


@query("chroma_round_trip", f"WITH {PX}, {BLK}, {BASIS}, {DCT} SELECT {BK}, (w * 8 + u)::INT AS i, {s4('v')} AS v FROM dct WHERE c > 0")
def chroma_round_trip(spark, sf):
    return _long(B.chroma_rebuild(B.chroma_factor(B.dct(_blocks(spark, sf)))), "coef")


@query("progressive_pass", (
    f"WITH {_SCAN} SELECT {BK}, count(*) FILTER (k = 0 AND q <> 0) AS pass0, count(*) FILTER (k BETWEEN 1 AND 15 AND q <> 0) AS pass1, "
    f"count(*) FILTER (k > 15 AND q <> 0) AS pass2 FROM sq GROUP BY ALL"
))
def progressive_pass(spark, sf):
    n = lambda p: F.size(F.filter(F.transform("s", lambda v, k: F.struct(v.alias("v"), B.pass_of(k).alias("p"))),
        lambda x: (x["v"] != 0) & (x["p"] == p))).cast("long").alias(f"pass{p}")
    return _scanned(spark, sf).select(*longs(*BKEYS), n(0), n(1), n(2))


@query("quality_layers", f"SELECT i::INT AS layer, {s4('6.6 * pow(1.1 / 6.6, i / 3.0)')} AS distance FROM range(4) t(i)")
def quality_layers(spark, sf):
    d = spark.createDataFrame(list(enumerate(B.quality_layers(1.1, 4))), "layer int, distance double")
    return d.select("layer", r4(F.col("distance")).alias("distance"))


@query("block_size_select", f"""WITH {PX}, v AS (SELECT image_id, c, y // 8 AS by, x // 8 AS bx, greatest(0, avg((v / 255.0::DOUBLE) * (v / 255.0::DOUBLE)) - avg(v / 255.0::DOUBLE) * avg(v / 255.0::DOUBLE)) AS a FROM px GROUP BY ALL),
  n AS (SELECT p.*, r.a AS b, d.a AS l, x.a AS r FROM v p LEFT JOIN v r ON r.image_id = p.image_id AND r.c = p.c AND r.by = p.by AND r.bx = p.bx + 1 LEFT JOIN v d ON d.image_id = p.image_id AND d.c = p.c AND d.by = p.by + 1 AND d.bx = p.bx
  LEFT JOIN v x ON x.image_id = p.image_id AND x.c = p.c AND x.by = p.by + 1 AND x.bx = p.bx + 1)
  SELECT {BK}, {s4('a')} AS variance, CASE WHEN 32 - bx * 8 < 16 OR 32 - "by" * 8 < 16 THEN '8x8' WHEN greatest(a, b, l, r) < 0.005 THEN CASE WHEN 32 - bx * 8 >= 32 AND 32 - "by" * 8 >= 32 THEN '32x32' ELSE '16x16' END
  WHEN greatest(a + b, a + l) / 2 / greatest(1.1754943508222875e-38, least(a + b, a + l) / 2) > 2 AND (a + b + l + r) / 4 < 0.05 THEN CASE WHEN b > l THEN '16x8' ELSE '8x16' END ELSE '8x8' END AS size FROM n""")
def block_size_select(spark, sf):
    px = R.embedding_pictures(spark, sf).withColumn("v", F.col("v") / 255.0)
    return B.block_sizes(px, 32, 32).select(*longs(*BKEYS), r4(F.col("a")).alias("variance"), "size")


@query("block_sizes_table", (
    "SELECT * FROM (VALUES ('8x8', 64), ('16x8', 128), ('8x16', 128), ('16x16', 256), ('32x8', 256), ('8x32', 256), ('32x16', 512), "
    "('16x32', 512), ('32x32', 1024)) t(name, samples)"
))
def block_sizes_table(spark, sf):
    return spark.createDataFrame([(f"{w}x{h}", w * h) for w, h in B.SIZES], "name string, samples int")


@query("matrix_multiply", "WITH m AS (SELECT vec_id AS k, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT a.i AS i, b.i AS j, " + s4("sum(a.v * b.v)") + " AS v FROM m a JOIN m b USING (k) GROUP BY ALL")
def matrix_multiply(spark, sf):
    """The transposed matrix of all vectors times itself: 64 x 64, whatever the number of vectors."""
    m = R.table(spark, sf, "embeddings").select(F.col("vec_id").alias("k"), F.posexplode("embedding").alias("i", "v")).withColumn("v",
        F.col("v").cast("double"))
    return B.matrix_multiply(m, m.withColumnRenamed("i", "j")).select(*longs("i", "j"), r4(F.col("v")).alias("v"))
