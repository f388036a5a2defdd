"""Queries of metrics, entropy statistics, motion, containers, synthesis and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import entropy as E
from ..operators import metrics as A
from ..operators import motion as M
from ..operators import reports as T
from ..sources import containers as X
from ..sources import rasters as R
from .registry import EV, PAIR, PX, longs, query, r4, s4

KEYS = ("image_id", "c", "y", "x")


def _pair(spark, sf):
    px = R.embedding_pictures(spark, sf)
    return px.select(*KEYS, F.col("v").alias("a"), (F.col("v") - F.col("v") % 8).alias("b"))


_DB = "CASE WHEN mse = 0 THEN 'Infinity'::DOUBLE ELSE round(10 * log10(65025 / mse), 4) END"


@query("psnr", (
    f"WITH {PX}, {PAIR}, m AS (SELECT image_id, c, avg((a - b) * (a - b)) AS mse FROM pair GROUP BY ALL), u AS (SELECT * FROM m UNION ALL "
    f"SELECT image_id, NULL, avg(mse) FROM m GROUP BY 1) SELECT image_id, c, {s4('mse')} AS mse, {_DB} AS psnr FROM u"
))
def psnr(spark, sf):
    d = A.psnr(_pair(spark, sf))
    return d.select(*longs("image_id", "c"), r4(F.col("mse")).alias("mse"), F.round("psnr", 4).alias("psnr"))


@query("psnr_pooled", f"WITH {PX}, {PAIR}, m AS (SELECT image_id, avg((a - b) * (a - b)) AS mse FROM pair GROUP BY ALL) SELECT image_id, {_DB} AS psnr FROM m")
def psnr_pooled(spark, sf):
    return A.pooled_psnr(_pair(spark, sf)).select(*longs("image_id"), F.round("psnr", 4).alias("psnr"))


_MOM = "avg(a) AS ma, avg(b) AS mb, avg(a * a) AS aa, avg(b * b) AS bb, avg(a * b) AS ab"
_LUM = "(2 * ma * mb + 6.5025) / (ma * ma + mb * mb + 6.5025)"
_CS = "(2 * (ab - ma * mb) + 58.5225) / ((aa - ma * ma) + (bb - mb * mb) + 58.5225)"


@query("ssim", (
    f"WITH {PX}, {PAIR}, w AS (SELECT image_id, c, wy, wx, {_MOM} FROM pair JOIN range(25) p(wy) ON y BETWEEN wy AND wy + 7 JOIN range(25) "
    f"q(wx) ON x BETWEEN wx AND wx + 7 GROUP BY ALL), k AS (SELECT image_id, c, avg({_LUM} * {_CS}) AS s FROM w GROUP BY ALL) SELECT "
    f"image_id, {s4('avg(s)')} AS ssim FROM k GROUP BY 1"
))
def ssim(spark, sf):
    return A.ssim(_pair(spark, sf), 32, 32).select(*longs("image_id"), r4(F.col("ssim")).alias("ssim"))


_SCALE = lambda n, src: (
    f"SELECT image_id, avg({_LUM}) AS lum, avg({_CS}) AS cs FROM (SELECT image_id, c, y // 8, x // 8, {_MOM} FROM {src} GROUP BY ALL) GROUP "
    f"BY 1"
)
_HALF = lambda src: f"SELECT image_id, c, y // 2 AS y, x // 2 AS x, avg(a) AS a, avg(b) AS b FROM {src} GROUP BY ALL"


@query("ms_ssim", (
    f"WITH {PX}, {PAIR}, p2 AS ({_HALF('pair')}), p4 AS ({_HALF('p2')}), a AS ({_SCALE(0, 'pair')}), b AS ({_SCALE(1, 'p2')}), d AS "
    f"({_SCALE(2, 'p4')}) SELECT image_id, "
    f"{s4('least(1, pow(greatest(0, a.cs), 0.0448) * pow(greatest(0, b.cs), 0.2856) * pow(greatest(0, d.cs), 0.3001) * pow(greatest(0, d.lum), 0.3001))')} "
    f"AS ms_ssim FROM a JOIN b USING (image_id) JOIN d USING (image_id)"
))
def ms_ssim(spark, sf):
    return A.ms_ssim(_pair(spark, sf), 32, 32).select(*longs("image_id"), r4(F.col("ms_ssim")).alias("ms_ssim"))


_OPP = lambda v: (
    f"(SELECT image_id, y, x, r - g AS o0, (r + g) / 2 AS o1, b - (r + g) / 2 AS o2 FROM (SELECT image_id, y, x, "
    f"{', '.join(f'max(pow({v} / 255.0::DOUBLE, 1.0::DOUBLE / 3)) FILTER (c = {i}) AS {n}' for i, n in enumerate('rgb'))} FROM pair GROUP "
    f"BY ALL))"
)
_MASK = lambda i, w: f"pow(abs(p.o{i} - q.o{i}) / (1 + 0.3::DOUBLE * greatest(abs(p.o{i}), 1)), 2) * {w}"


@query("perceptual_distance", (
    f"WITH {PX}, {PAIR}, d AS (SELECT p.image_id, sqrt({_MASK(0, 1)} + {_MASK(1, 0.7)} + {_MASK(2, 0.3)}) AS d FROM {_OPP('a')} p JOIN "
    f"{_OPP('b')} q USING (image_id, y, x)) SELECT image_id, {s4('0.6 * max(d) + 0.4 * avg(d)')} AS distance FROM d GROUP BY 1"
))
def perceptual_distance(spark, sf):
    px = R.embedding_pictures(spark, sf)
    d = A.perceptual_distance(px, px.withColumn("v", F.col("v") - F.col("v") % 8))
    return d.select(*longs("image_id"), r4(F.col("distance")).alias("distance"))


_ALL = f"""WITH {PX}, {PAIR}, m AS (SELECT image_id, c, avg((a - b) * (a - b)) AS mse FROM pair GROUP BY ALL), o AS (SELECT image_id, avg(mse) AS mse FROM m GROUP BY 1),
  p2 AS ({_HALF('pair')}), p4 AS ({_HALF('p2')}), a AS ({_SCALE(0, 'pair')}), b AS ({_SCALE(1, 'p2')}), d AS ({_SCALE(2, 'p4')}),
  w AS (SELECT image_id, c, wy, wx, {_MOM} FROM pair JOIN range(25) p(wy) ON y BETWEEN wy AND wy + 7 JOIN range(25) q(wx) ON x BETWEEN wx AND wx + 7 GROUP BY ALL),
  k AS (SELECT image_id, c, avg({_LUM} * {_CS}) AS s FROM w GROUP BY ALL), s AS (SELECT image_id, avg(s) AS ssim FROM k GROUP BY 1),
  e AS (SELECT p.image_id, sqrt({_MASK(0, 1)} + {_MASK(1, 0.7)} + {_MASK(2, 0.3)}) AS d FROM {_OPP('a')} p JOIN {_OPP('b')} q USING (image_id, y, x)),
  f AS (SELECT image_id, 0.6 * max(d) + 0.4 * avg(d) AS distance FROM e GROUP BY 1)"""
_WEIGHED = (
    "least(1, pow(greatest(0, a.cs), 0.0448) * pow(greatest(0, b.cs), 0.2856) * pow(greatest(0, d.cs), 0.3001) * pow(greatest(0, d.lum), "
    "0.3001))"
)


@query("all_metrics", (
    f"{_ALL} SELECT image_id, {_DB} AS psnr, {s4('ssim')} AS ssim, {s4(_WEIGHED)} AS ms_ssim, {s4('distance')} AS distance FROM o JOIN a "
    f"USING (image_id) JOIN b USING (image_id) JOIN d USING (image_id) JOIN s USING (image_id) JOIN f USING (image_id)"
))
def all_metrics(spark, sf):
    pair, px = _pair(spark, sf), R.embedding_pictures(spark, sf)
    d = A.psnr(pair).where("c IS NULL").select("image_id", F.round("psnr", 4).alias("psnr"))
    d = d.join(A.ssim(pair, 32, 32), "image_id").join(A.ms_ssim(pair, 32, 32),
        "image_id").join(A.perceptual_distance(px, px.withColumn("v", F.col("v") - F.col("v") % 8)), "image_id")
    return d.select(*longs("image_id"), "psnr", *[r4(F.col(k)).alias(k) for k in ("ssim", "ms_ssim", "distance")])


@query("downsample", f"WITH {PX} SELECT image_id, c, y // 2 AS y, x // 2 AS x, {s4('avg(v)')} AS v FROM px GROUP BY ALL")
def downsample(spark, sf):
    return A.downsample(R.embedding_pictures(spark, sf), 32, 32, "v").select(*longs(*KEYS), r4(F.col("v")).alias("v"))


@query("vector_statistics", (
    f"WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS e FROM embeddings) SELECT vec_id, {s4('sum(e)')} AS total, {s4('avg(e)')} AS "
    f"mean, {s4('stddev_pop(e)')} AS deviation, {s4('sqrt(sum(e * e))')} AS norm, {s4('max(e)')} AS largest, {s4('min(e)')} AS smallest "
    f"FROM e GROUP BY 1"
))
def vector_statistics(spark, sf):
    d = A.vector_statistics(R.table(spark, sf, "embeddings"))
    return d.select("vec_id", *[r4(F.col(k)).alias(k) for k in ("total", "mean", "deviation", "norm", "largest", "smallest")])


@query("normalised_vectors", (
    f"WITH e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS e FROM embeddings), m AS (SELECT vec_id, i, e - avg(e) "
    f"OVER (PARTITION BY vec_id) AS e FROM e) SELECT vec_id, i::INT AS i, {s4('e / sqrt(sum(e * e) OVER (PARTITION BY vec_id))')} AS e FROM "
    f"m"
))
def normalised_vectors(spark, sf):
    d = A.normalised(R.table(spark, sf, "embeddings")).select("vec_id", F.posexplode("e").alias("i", "e"))
    return d.select("vec_id", F.col("i").cast("int").alias("i"), r4(F.col("e")).alias("e"))


@query("similarity_filter", (
    f"WITH e AS (SELECT vec_id, vec_id // 2 AS p, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS e FROM embeddings), d AS (SELECT "
    f"a.p, sum(a.e * b.e) / sqrt(sum(a.e * a.e) * sum(b.e * b.e)) AS s FROM e a JOIN e b ON a.p = b.p AND a.i = b.i AND a.vec_id < b.vec_id "
    f"GROUP BY 1) SELECT p AS pair, {s4('s')} AS similarity FROM d WHERE s >= 0.1"
))
def similarity_filter(spark, sf):
    e = R.table(spark, sf, "embeddings").groupBy(F.expr("vec_id div 2").alias("pair")).agg(F.min_by("embedding", "vec_id").alias("a"),
        F.max_by("embedding", "vec_id").alias("b"), F.count(F.lit(1)).alias("n")).where("n = 2")
    wide = lambda k: F.transform(k, lambda x: x.cast("double"))
    dot = lambda a, b: F.aggregate(F.zip_with(wide(a), wide(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    d = e.select("pair", (dot("a", "b") / F.sqrt(dot("a", "a") * dot("b", "b"))).alias("s")).where("s >= 0.1")
    return d.select("pair", r4(F.col("s")).alias("similarity"))


@query("alignment_check", (
    f"WITH {PX}, q AS (SELECT * FROM px WHERE NOT (image_id = 1 AND x = 31)) SELECT p.image_id, count(*) FILTER (q.v IS NULL) AS lone FROM "
    f"px p LEFT JOIN q USING (image_id, c, y, x) GROUP BY 1"
))
def alignment_check(spark, sf):
    px = R.embedding_pictures(spark, sf)
    return A.unmatched(px, px.where("NOT (image_id = 1 AND x = 31)")).select(*longs("image_id", "lone"))


@query("interleaved_bytes", f"WITH {EV} SELECT image_id, string_agg(format('{{:02X}}', v) || 'FF', '' ORDER BY y, x) AS bytes FROM ev GROUP BY 1")
def interleaved_bytes(spark, sf):
    d = A.interleave(R.event_frames(spark, sf), 16, 2)
    return d.select(*longs("image_id"), F.hex(A.to_bytes(F.col("samples"))).alias("bytes"))


@query("interleaved_wide", f"WITH {PX} SELECT image_id, string_agg(format('{{:04X}}', v * 257), '' ORDER BY y, x, c) AS bytes FROM px GROUP BY 1")
def interleaved_wide(spark, sf):
    px = R.embedding_pictures(spark, sf).withColumn("v", F.col("v") * 257)
    return A.interleave(px, 32, 3).select(*longs("image_id"), F.hex(A.to_bytes(F.col("samples"), 2)).alias("bytes"))


@query("interleaved_floats", (
    "WITH e AS (SELECT vec_id, unnest(range(64)) AS i, CAST(greatest(0, least(255, floor((unnest(embedding)::DOUBLE + 0.5) * 255 + 0.5))) "
    "AS INT) AS v FROM embeddings) SELECT vec_id, string_agg(format('{:02X}', v), '' ORDER BY i) AS bytes FROM e GROUP BY 1"
))
def interleaved_floats(spark, sf):
    v = F.transform("embedding", lambda x: S.clamp(F.floor((x.cast("double") + 0.5) * 255 + 0.5).cast("int"), 0, 255))
    return R.table(spark, sf, "embeddings").select("vec_id", F.hex(A.to_bytes(v)).alias("bytes"))


@query("raw_planes", f"WITH {PX} SELECT image_id, c, string_agg(format('{{:02X}}', v), '' ORDER BY y, x) AS bytes FROM px GROUP BY ALL")
def raw_planes(spark, sf):
    px = R.embedding_pictures(spark, sf).withColumn("image_id", F.col("image_id") * 3 + F.col("c")).withColumn("c", F.lit(0))
    d = A.interleave(px, 32, 1)
    return d.select(F.expr("image_id div 3").alias("image_id"), (F.col("image_id") % 3).alias("c"),
        F.hex(A.to_bytes(F.col("samples"))).alias("bytes"))


@query("pixmaps", (
    f"WITH {PX} SELECT image_id, hex('P6' || chr(10) || '32 32' || chr(10) || '255' || chr(10)) || string_agg(format('{{:02X}}', v), '' "
    f"ORDER BY y, x, c) AS bytes FROM px GROUP BY 1"
))
def pixmaps(spark, sf):
    return X.pixmaps(R.embedding_pictures(spark, sf), 32, 32).select(*longs("image_id"), F.hex("data").alias("bytes"))


@query("byte_compare", (
    "WITH d AS (SELECT doc_id AS id, octet_length(encode(text)) AS a, substr(text, 1, greatest(length(text) - 4, 0)) AS p FROM documents), "
    "s AS (SELECT id, coalesce(a, 0) AS a, coalesce(octet_length(encode(p)), 0) AS b, coalesce(p, '') AS p FROM d) SELECT id, a::INT AS "
    "size_a, b::INT AS size_b, (length(p) - length(replace(p, 'e', '')) + a - b)::INT AS differing, CASE WHEN contains(p, 'e') THEN "
    "octet_length(encode(split_part(p, 'e', 1))) WHEN a > b THEN b ELSE -1 END::INT AS first_offset, "
) + s4("b::DOUBLE / nullif(a, 0)") + " AS ratio FROM s")
def byte_compare(spark, sf):
    """Whole texts against copies without their last four characters, with other letters for e."""
    d = R.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    a = d.select("id", F.encode("text", "utf-8").alias("data"))
    b = d.select("id", F.encode(F.replace(F.expr("substring(text, 1, greatest(length(text) - 4, 0))"), F.lit("e"), F.lit("a")),
        "utf-8").alias("data"))
    return A.byte_compare(a, b).select("id", "size_a", "size_b", "differing", "first_offset", r4(F.col("ratio")).alias("ratio"))


@query("byte_differences", (
    "WITH d AS (SELECT doc_id AS id, string_split(text, 'e') AS p FROM documents), o AS (SELECT id, unnest(range(1, len(p))) AS i, "
    "unnest(p[:-2]) AS t FROM d), s AS (SELECT id, i, sum(octet_length(encode(t)) + 1) OVER (PARTITION BY id ORDER BY i) - 1 AS pos FROM "
    "o) SELECT id, pos::INT AS \"at\", '65' AS a, '61' AS b FROM s WHERE i <= 20"
))
def byte_differences(spark, sf):
    """The first 20 differing bytes of each document, over its whole text."""
    data = lambda c: F.encode(c, "utf-8")
    one = lambda x, i: F.substring(x, i, F.lit(1))
    d = R.table(spark, sf, "documents").where("octet_length(text) > 0").select(F.col("doc_id").alias("id"), "text")
    odd = lambda a, b: F.slice(F.filter(F.sequence(F.lit(1), F.least(F.octet_length(a), F.octet_length(b))), lambda i: one(a, i) != one(b, i)), 1,
        20)
    first = S.let(data(F.col("text")),
        lambda a: S.let(data(F.replace("text", F.lit("e"), F.lit("a"))),
            lambda b: F.transform(odd(a, b), lambda i: F.struct((i - 1).alias("at"), F.hex(one(a, i)).alias("a"), F.hex(one(b, i)).alias("b")))))
    return d.select("id", F.explode(first).alias("x")).select("id", "x.at", "x.a", "x.b")


@query("tiles", (
    f"WITH {PX} SELECT image_id, c, y // 12 AS ty, x // 12 AS tx, sum(v)::BIGINT AS total, count(*) AS n, least(12, 32 - x // 12 * 12)::INT "
    f"AS w, least(12, 32 - y // 12 * 12)::INT AS h FROM px GROUP BY ALL"
))
def tiles(spark, sf):
    return A.tiles(R.embedding_pictures(spark, sf), 12, 32, 32).select(*longs("image_id", "c", "ty", "tx", "total", "n"), "w", "h")


# symbols

_SYM = "sym AS (SELECT event_type AS ctx, CAST(floor(value) AS INT) % 32 AS sym, event_id AS pos FROM events)"
_HIST = f"{_SYM}, hist AS (SELECT ctx, sym, count(*) AS n FROM sym GROUP BY ALL)"


def _symbols(spark, sf):
    return R.table(spark, sf, "events").select(F.col("event_type").alias("ctx"), (F.floor("value").cast("int") % 32).alias("sym"),
        F.col("event_id").alias("pos"))


@query("histogram", (
    f"WITH {_HIST} SELECT c.ctx, s.sym::INT AS sym, coalesce(n, 0) AS n FROM (SELECT DISTINCT ctx FROM sym) c JOIN range(32) s(sym) ON true "
    f"LEFT JOIN hist h ON h.ctx = c.ctx AND h.sym = s.sym"
))
def histogram(spark, sf):
    return E.full_histogram(_symbols(spark, sf), 32).select("ctx", "sym", F.col("n").cast("long").alias("n"))


_NORM = f"""{_HIST}, f AS (SELECT ctx, sym, n, greatest(1, n * 4096 // sum(n) OVER (PARTITION BY ctx)) AS f, row_number() OVER (PARTITION BY ctx ORDER BY n DESC, sym) AS rank, count(*) OVER (PARTITION BY ctx) AS k FROM hist),
  l AS (SELECT *, 4096 - sum(f) OVER (PARTITION BY ctx) AS l, coalesce(sum(f - 1) OVER (PARTITION BY ctx ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM f),
  q AS (SELECT ctx, sym, n, (CASE WHEN l >= 0 THEN f + l // k + CASE WHEN rank <= l % k THEN 1 ELSE 0 END ELSE f - greatest(0, least(f - 1, -l - b)) END)::BIGINT AS freq FROM l),
  dist AS (SELECT *, coalesce(sum(freq) OVER (PARTITION BY ctx ORDER BY sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cum FROM q)"""


@query("normalised_distribution", f"WITH {_NORM} SELECT ctx, sym, n, freq, cum FROM dist")
def normalised_distribution(spark, sf):
    return E.normalise(E.histogram(_symbols(spark, sf)))


@query("slot_lookup", (
    f"WITH {_NORM} SELECT e.event_id, d.sym FROM events e JOIN dist d ON d.ctx = e.event_type AND e.event_id % 4096 >= cum AND e.event_id % "
    f"4096 < cum + freq"
))
def slot_lookup(spark, sf):
    slots = R.table(spark, sf, "events").select("event_id", F.col("event_type").alias("ctx"), (F.col("event_id") % 4096).alias("slot"))
    return E.slot_lookup(slots, E.normalise(E.histogram(_symbols(spark, sf)))).select("event_id", "sym")


@query("entropy_bits", f"WITH {_NORM} SELECT ctx, {s4('sum(-n * log2(freq / 4096.0::DOUBLE))')} AS bits, sum(n)::BIGINT AS n FROM dist GROUP BY 1")
def entropy_bits(spark, sf):
    return E.entropy_bits(E.normalise(E.histogram(_symbols(spark, sf)))).select("ctx", r4(F.col("bits")).alias("bits"), "n")


_JSD = f"""{_HIST}, p AS (SELECT ctx, sym, n / sum(n) OVER (PARTITION BY ctx) AS p FROM hist), c AS (SELECT DISTINCT ctx FROM hist), g AS (SELECT a.ctx AS a, b.ctx AS b, s.sym FROM c a JOIN c b ON a.ctx < b.ctx JOIN range(32) s(sym) ON true),
  j AS (SELECT g.a, g.b, coalesce(x.p, 0) AS p, coalesce(y.p, 0) AS q FROM g LEFT JOIN p x ON x.ctx = g.a AND x.sym = g.sym LEFT JOIN p y ON y.ctx = g.b AND y.sym = g.sym),
  jsd AS (SELECT a, b, sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2 AS jsd FROM j GROUP BY ALL)"""


@query("js_divergence", f"WITH {_JSD} SELECT a, b, {s4('jsd')} AS jsd FROM jsd")
def js_divergence(spark, sf):
    return E.divergence(E.histogram(_symbols(spark, sf))).select("a", "b", r4(F.col("jsd")).alias("jsd"))


@query("first_merge", f"WITH {_JSD} SELECT a, b FROM jsd ORDER BY jsd, a, b LIMIT 1")
def first_merge(spark, sf):
    return E.closest_pair(E.histogram(_symbols(spark, sf))).select("a", "b")


@query("context_clusters")
def context_clusters(spark, sf):
    return E.cluster(E.histogram(_symbols(spark, sf)), 2)


@query("clustered_histogram")
def clustered_histogram(spark, sf):
    hist = E.histogram(_symbols(spark, sf))
    return hist.join(F.broadcast(E.cluster(hist, 2)), "ctx").groupBy("cluster", "sym").agg(F.sum("n").alias("n"))


@query("interleaved_streams", f"WITH {_SYM} SELECT (pos % 4)::INT AS stream, pos // 4 AS pos, ctx, sym FROM sym")
def interleaved_streams(spark, sf):
    return E.split_streams(_symbols(spark, sf)).select("stream", "pos", "ctx", "sym")


@query("frequency_order", f"WITH {_HIST} SELECT ctx, sym, row_number() OVER (PARTITION BY ctx ORDER BY n DESC, sym)::INT AS rank FROM hist")
def frequency_order(spark, sf):
    w = Window.partitionBy("ctx").orderBy(F.desc("n"), "sym")
    return E.histogram(_symbols(spark, sf)).select("ctx", "sym", F.row_number().over(w).alias("rank"))


@query("varint_length", (
    "SELECT event_id, CASE WHEN event_id * event_id < 128 THEN 1 WHEN event_id * event_id < 16384 THEN 2 WHEN event_id * event_id < "
    "2097152 THEN 3 WHEN event_id * event_id < 268435456 THEN 4 ELSE 5 END::INT AS bytes FROM events"
))
def varint_length(spark, sf):
    return R.table(spark, sf, "events").select("event_id", S.varint_bytes(F.col("event_id") * F.col("event_id")).alias("bytes"))


@query("size_header_bits", (
    "SELECT event_id + 1 AS n, CASE WHEN event_id < 256 THEN 8 WHEN event_id < 512 THEN 11 WHEN event_id < 8192 THEN 15 WHEN event_id < "
    "262144 THEN 20 ELSE 32 END::INT AS bits FROM events"
))
def size_header_bits(spark, sf):
    n = F.col("event_id") + 1
    return R.table(spark, sf, "events").select(n.alias("n"), S.size_header_bits(n).cast("int").alias("bits"))


@query("table_runs", (
    f"WITH {_NORM}, r AS (SELECT ctx, sym, freq, CASE WHEN lag(freq) OVER w IS DISTINCT FROM freq OR lag(sym) OVER w IS DISTINCT FROM sym - "
    f"1 THEN 1 ELSE 0 END AS new FROM dist WINDOW w AS (PARTITION BY ctx ORDER BY sym)) SELECT ctx, sum(new)::BIGINT AS runs, count(*) AS "
    f"symbols FROM r GROUP BY 1"
))
def table_runs(spark, sf):
    return E.table_bytes(E.normalise(E.histogram(_symbols(spark, sf)))).select("ctx", *longs("runs", "symbols"))


@query("rans_round_trip", f"WITH {_SYM} SELECT (pos % 4)::INT AS stream, count(*) AS n, true AS exact FROM sym GROUP BY 1")
def rans_round_trip(spark, sf):
    return E.rans_round_trip(E.split_streams(_symbols(spark, sf))).select("stream", "n", "exact")


@query("rans_single_context", f"WITH {_SYM} SELECT (pos % 4)::INT AS stream, count(*) AS n, true AS exact FROM sym GROUP BY 1")
def rans_single_context(spark, sf):
    return E.rans_round_trip(E.split_streams(_symbols(spark, sf)), False).select("stream", "n", "exact")


@query("match_round_trip", f"WITH {_SYM} SELECT (pos % 8)::INT AS stream, count(*) AS n, true AS exact FROM sym GROUP BY 1")
def match_round_trip(spark, sf):
    return E.match_round_trip(E.split_streams(_symbols(spark, sf), 8)).select("stream", "n", "exact")


# frames

_BEST = f"""{EV}, blk AS (SELECT image_id, y // 4 AS bty, x // 4 AS btx, y % 4 AS j, x % 4 AS i, v FROM ev),
  s AS (SELECT a.image_id, a.bty, a.btx, b.bty AS sy, b.btx AS sx, 1 - sum(abs(a.v - b.v)) / (16 * 255.0::DOUBLE) AS s FROM blk a JOIN blk b ON b.image_id = a.image_id - 1 AND abs(a.bty - b.bty) <= 1 AND abs(a.btx - b.btx) <= 1 AND a.i = b.i AND a.j = b.j GROUP BY ALL),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, bty, btx ORDER BY CASE WHEN s >= 0.7 THEN s ELSE 0 END DESC, sy, sx) AS r FROM s) WHERE r = 1 AND s >= 0.7)"""


def _found(spark, sf):
    return M.search(R.event_frames(spark, sf), 4, 1, 0.7)


@query("motion_search", f"WITH {_BEST} SELECT image_id, bty AS block_y, btx AS block_x, sy, sx, {s4('s')} AS similarity FROM best")
def motion_search(spark, sf):
    return _found(spark, sf).select(*longs("image_id"), F.col("by").alias("block_y"), F.col("bx").alias("block_x"), *longs("sy", "sx"),
        r4(F.col("similarity")).alias("similarity"))


_MERGED = f"""{_BEST}, d AS (SELECT image_id, bty, btx, sy - bty AS dy, sx - btx AS dx FROM best), i AS (SELECT *, btx - row_number() OVER (PARTITION BY image_id, bty, dy, dx ORDER BY btx) AS g FROM d),
  m AS (SELECT image_id, bty * 4 AS y, min(btx) * 4 AS x, count(*) * 4 AS w, 4::BIGINT AS h, dy, dx FROM i GROUP BY image_id, bty, dy, dx, g)"""


@query("patch_merge_rows", f"WITH {_MERGED} SELECT image_id, y, x, w, h, dy, dx FROM m")
def patch_merge_rows(spark, sf):
    return M.merge_rows(_found(spark, sf), 4).select(*longs("image_id", "y", "x", "w", "h", "dy", "dx"))


@query("patch_top", (
    f"WITH {_MERGED} SELECT image_id, y, x, w, h FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY w * h DESC, y, x) AS r "
    f"FROM m) WHERE r <= 3"
))
def patch_top(spark, sf):
    return M.largest(M.merge_rows(_found(spark, sf), 4), 3).select(*longs("image_id", "y", "x", "w", "h"))


@query("patch_merge_greedy")
def patch_merge_greedy(spark, sf):
    return M.merge_greedy(M.merge_rows(_found(spark, sf), 4))


_PATCH = (
    "patch AS (SELECT event_id // 16 AS image_id, event_id AS patch, event_id * 7 % 48 AS x, event_id * 11 % 48 AS y, 4 + event_id % 9 AS "
    "w, 4 + event_id % 7 AS h FROM events)"
)


@query("patch_overlap", (
    f"WITH {_PATCH} SELECT a.image_id, a.patch AS a, b.patch AS b FROM patch a JOIN patch b ON a.image_id = b.image_id AND a.patch < "
    f"b.patch AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h"
))
def patch_overlap(spark, sf):
    d = R.table(spark, sf, "events").select(F.expr("event_id div 16").alias("image_id"), F.col("event_id").alias("patch"),
        F.expr("event_id * 7 % 48").alias("x"), F.expr("event_id * 11 % 48").alias("y"), F.expr("4 + event_id % 9").alias("w"),
            F.expr("4 + event_id % 7").alias("h"))
    return M.overlapping_pairs(d, 16)


@query("frame_delta", (
    f"WITH {EV} SELECT a.image_id, a.image_id - a.image_id % 4 AS key_id, a.y, a.x, (a.v - k.v)::INT AS delta FROM ev a JOIN ev k ON "
    f"k.image_id = a.image_id - a.image_id % 4 AND k.y = a.y AND k.x = a.x"
))
def frame_delta(spark, sf):
    return M.key_deltas(R.event_frames(spark, sf), 4).select(*longs("image_id", "key_id", "y", "x"), F.col("delta").cast("int").alias("delta"))


@query("as_of_join", (
    "SELECT DISTINCT e.user_id, e.event_id, p.value FROM events e ASOF LEFT JOIN (SELECT user_id, event_id, value FROM events WHERE "
    "event_type = 'purchase') p ON e.user_id = p.user_id AND e.event_id >= p.event_id"
))
def as_of_join(spark, sf):
    e = R.table(spark, sf, "events")
    return M.as_of(e, e.where("event_type = 'purchase'"), "user_id", "event_id", "value")


@query("noise_gaussian")
def noise_gaussian(spark, sf):
    return M.gaussian_noise(spark, 200, 42)


@query("box_muller", (
    f"SELECT event_id, "
    f"{s4('2 * sqrt(-2 * ln(greatest((event_id % 97) / 97.0::DOUBLE, 1e-10))) * cos(2 * pi() * ((event_id % 89) / 89.0::DOUBLE))')} AS z "
    f"FROM events"
))
def box_muller(spark, sf):
    return R.table(spark, sf, "events").select("event_id",
        r4(M.box_muller((F.col("event_id") % 97) / 97.0, (F.col("event_id") % 89) / 89.0, 2.0)).alias("z"))


@query("noise_weights", "SELECT i::INT AS i, CASE WHEN i = 0 THEN 0.1 WHEN i < 8 THEN 0.5 ELSE 1.0 END::DOUBLE AS weight FROM range(64) t(i)")
def noise_weights(spark, sf):
    return spark.range(64).select(F.col("id").cast("int").alias("i"), M.noise_weight(F.col("id")).alias("weight"))


@query("spline_line", (
    f"SELECT event_id, {s4('value * sqrt(2.0::DOUBLE)')} AS colour_dc, {s4('(event_id % 7) * sqrt(2.0::DOUBLE)')} AS sigma_dc, 2::INT AS "
    f"points FROM events"
))
def spline_line(spark, sf):
    d = R.table(spark, sf, "events").select("event_id",
        F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")), F.struct(F.lit(8).alias("x"), F.lit(8).alias("y"))).alias("points"),
            F.concat(F.array(F.col("value") * 2**0.5), F.array_repeat(F.lit(0.0), 31)).alias("colour"),
                F.concat(F.array((F.col("event_id") % 7) * 2**0.5), F.array_repeat(F.lit(0.0), 31)).alias("sigma"))
    return d.select("event_id", r4(F.get("colour", F.lit(0))).alias("colour_dc"), r4(F.get("sigma", F.lit(0))).alias("sigma_dc"),
        F.size("points").alias("points"))


# containers


def _files(spark, sf):
    d = R.table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.encode("text", "utf-8").alias("t"),
        (F.col("doc_id") % 10).cast("int").alias("o"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), p.alias("payload")) for k,
        p in (("jxlc", F.concat(F.unhex(F.lit("FF0A")), "t")), ("Exif", F.concat(X.big_endian(F.lit(0), 4), X.exif_block(F.col("o")))),
            ("xml ", F.encode(F.concat(F.lit("<x>"), F.col("file_id").cast("string"), F.lit("</x>")), "utf-8")),
                ("ftyp", F.encode(F.lit("jxl \0\0\0\0jxl "), "utf-8")), ("JXL ", F.lit(X.SIGNATURE)))])
    return d.select("file_id", F.posexplode(kinds).alias("seq", "b")).select("file_id", "seq", "b.kind", "b.payload")


@query("box_bytes", "SELECT doc_id AS file_id, format('{:08X}', octet_length(encode(text)) + 8) || hex('xml ') || hex(text) AS bytes FROM documents")
def box_bytes(spark, sf):
    t = F.encode("text", "utf-8")
    return R.table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.hex(X.box(F.lit("xml "), t)).alias("bytes"))


@query("container_round_trip", (
    "SELECT doc_id AS file_id, i::BIGINT AS seq, ['JXL ', 'ftyp', 'Exif', 'xml ', 'jxlc'][i + 1] AS kind, [4, 12, 30, "
    "octet_length(encode('<x>' || doc_id || '</x>')), octet_length(encode(text)) + 2][i + 1]::INT AS size FROM documents, range(5) t(i)"
))
def container_round_trip(spark, sf):
    return X.read_boxes(X.containers(_files(spark, sf))).select("file_id", "seq", "kind", F.octet_length("payload").alias("size"))


@query("codestream", "SELECT doc_id AS file_id, 'FF0A' || hex(encode(text)) AS stream FROM documents")
def codestream(spark, sf):
    return X.codestream(X.containers(_files(spark, sf))).select("file_id", F.hex("stream").alias("stream"))


@query("container_metadata", "SELECT doc_id AS file_id, '<x>' || doc_id || '</x>' AS xml, greatest(1, least(8, doc_id % 10))::INT AS orientation FROM documents")
def container_metadata(spark, sf):
    d = X.metadata(X.containers(_files(spark, sf)))
    return d.select("file_id", F.decode("xml", "utf-8").alias("xml")).join(X.orientations(d), "file_id")


@query("exif_block", (
    "SELECT DISTINCT doc_id % 10 AS o, '4D4D002A0000000800010112000300000001' || format('{:04X}', greatest(1, least(8, doc_id % 10))) || "
    "'000000000000' AS bytes FROM documents"
))
def exif_block(spark, sf):
    o = F.col("doc_id") % 10
    return R.table(spark, sf, "documents").select(o.alias("o"), F.hex(X.exif_block(o)).alias("bytes")).distinct()


@query("frame_index", (
    "SELECT user_id AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, event_id % 1000 AS size, event_id * "
    "100000 AS \"offset\", event_id % 50 AS duration FROM events"
))
def frame_index(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    d = R.table(spark, sf, "events").select(F.col("user_id").alias("file_id"), (F.row_number().over(w) - 1).alias("i"),
        (F.col("event_id") % 1000).alias("size"), (F.col("event_id") * 100000).alias("offset"), (F.col("event_id") % 50).alias("duration"))
    return X.read_frame_index(X.frame_index(d)).select(*longs("file_id", "i", "size", "offset", "duration"))


def _headers(spark, sf):
    d = R.table(spark, sf, "events").select(F.col("event_id").alias("file_id"), (F.col("event_id") * 13 % 5000).alias("w"),
        (F.col("event_id") * 17 % 5000 + 1).alias("h"), (F.col("event_id") % 6).alias("ch"))
    return d.select("file_id", X.image_header(F.col("w"), F.col("h"), F.lit(8), F.col("ch"), F.lit(0), F.lit(0)).alias("data"))


@query("image_header", (
    "SELECT event_id AS file_id, event_id * 13 % 5000 AS width, event_id * 17 % 5000 + 1 AS height, 8::BIGINT AS bits, event_id % 6 AS "
    "channels FROM events"
))
def image_header(spark, sf):
    h = X.read_image_header(F.col("data"))
    return _headers(spark, sf).select("file_id", *[h[k].alias(k) for k in ("width", "height", "bits", "channels")])


@query("structure_checks", (
    "SELECT event_id AS file_id, true AS not_empty, true AS long_enough, true AS signature, event_id * 13 % 5000 >= 1 AS width_ok, true AS "
    "height_ok, event_id % 6 BETWEEN 1 AND 4 AS channels_ok, event_id * 13 % 5000 >= 1 AND event_id % 6 BETWEEN 1 AND 4 AS passed FROM "
    "events"
))
def structure_checks(spark, sf):
    return T.structure_checks(_headers(spark, sf)).select("file_id", "not_empty", "long_enough", "signature", "width_ok", "height_ok", "channels_ok",
        "passed")


_SIDE = lambda n: f"CASE WHEN {n} - 1 < 512 THEN '00' || format('{{:09b}}', {n} - 1) ELSE CASE WHEN {n} - 1 < 8192 THEN '01' || format('{{:013b}}', {n} - 1) ELSE '10' || format('{{:018b}}', {n} - 1) END END"
_HEAD = f"""WITH f AS (SELECT event_id, event_id * 13 % 9000 + 1 AS w, event_id * 7 % 300 + 1 AS h FROM events),
  t AS (SELECT event_id, CASE WHEN greatest(w, h) <= 256 THEN '1' || format('{{:08b}}', w - 1) || format('{{:08b}}', h - 1) ELSE '0' || {_SIDE('w')} || {_SIDE('h')} END
    || CASE WHEN event_id % 20 = 0 AND event_id % 99 = 0 AND event_id % 8 = 0 THEN '1' ELSE '0' || format('{{:02b}}', event_id % 4) || format('{{:03b}}', event_id % 5)
      || format('{{:032b}}', event_id % 99) || CASE WHEN event_id % 2 = 0 THEN '1' ELSE '0' END || format('{{:03b}}', event_id % 8) END AS t FROM f),
  r AS (SELECT event_id, rpad(t, ((length(t) + 7) // 8 * 8)::INT, '0') AS t FROM t)
  SELECT event_id AS frame_id, list_aggregate(list_transform(range(1, length(t), 8), lambda i: format('{{:02X}}', ('0b' || substr(t, i, 8))::INT)), 'string_agg', '') AS bytes, true AS exact FROM r"""


@query("header_round_trip", _HEAD)
def header_round_trip(spark, sf):
    """The bytes of a size and a frame header, and whether all fields read back."""
    pick = lambda names, m: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % m + 1).cast("int"))
    d = R.table(spark, sf, "events").select(
        F.col("event_id").alias("frame_id"), (F.col("event_id") * 13 % 9000 + 1).alias("width"), (F.col("event_id") * 7 % 300 + 1).alias("height"),
        pick(X.FRAME_TYPES, 4).alias("type"), pick(X.BLENDS, 5).alias("blend"), (F.col("event_id") % 99).alias("duration"),
        (F.col("event_id") % 2 == 0).alias("last"), (F.col("event_id") % 8).alias("slot"),
    )
    return X.header_round_trip(d).select("frame_id", F.hex("data").alias("bytes"), "exact")


@query("sections", (
    "SELECT user_id AS frame_id, format('{:08X}', count(*)) || string_agg(format('{:08X}', octet_length(encode(event_type))), '' ORDER BY "
    "event_id) || string_agg(hex(event_type), '' ORDER BY event_id) AS bytes FROM events GROUP BY 1"
))
def sections(spark, sf):
    d = R.table(spark, sf, "events").select(F.col("user_id").alias("frame_id"), F.col("event_id").alias("i"),
        F.encode("event_type", "utf-8").alias("data"))
    return X.sections(d).select("frame_id", F.hex("data").alias("bytes"))


# reports

_BENCH = (
    "bench AS (SELECT l_returnflag || l_linestatus || '-' || l_linenumber AS name, l_returnflag AS category, sum(l_quantity)::DOUBLE AS "
    "seconds, sum(l_extendedprice)::DOUBLE AS pixels, sum(l_extendedprice)::DOUBLE AS bytes_in, sum(l_extendedprice * (1 - l_discount) / "
    "(1 + l_linenumber))::DOUBLE AS bytes_out, max(l_extendedprice)::DOUBLE AS memory FROM lineitem GROUP BY l_returnflag, l_linestatus, "
    "l_linenumber)"
)


def _bench(spark, sf):
    d = R.table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.sum("l_quantity").alias("seconds"),
        F.sum("l_extendedprice").alias("pixels"), F.sum(F.expr("l_extendedprice * (1 - l_discount) / (1 + l_linenumber)")).alias("bytes_out"),
            F.max("l_extendedprice").alias("memory"))
    return d.select(F.concat("l_returnflag", "l_linestatus", F.lit("-"), F.col("l_linenumber").cast("string")).alias("name"),
        F.col("l_returnflag").alias("category"), "seconds", "pixels", F.col("pixels").alias("bytes_in"), "bytes_out", "memory")


@query("speed_summary", (
    f"WITH {_BENCH} SELECT category, {s4('avg(seconds)')} AS mean_seconds, {s4('avg(pixels / 1e6 / seconds)')} AS mean_rate, "
    f"{s4('min(seconds)')} AS fastest, {s4('max(seconds)')} AS slowest, arg_min(name, (seconds, name)) AS fastest_name, arg_max(name, "
    f"(seconds, name)) AS slowest_name, count(*) AS n FROM bench GROUP BY 1"
))
def speed_summary(spark, sf):
    d = T.speed_summary(_bench(spark, sf))
    return d.select("category", *[r4(F.col(k)).alias(k) for k in ("mean_seconds", "mean_rate", "fastest", "slowest")], "fastest_name", "slowest_name",
        "n")


@query("compression_summary", (
    f"WITH {_BENCH}, r AS (SELECT name, bytes_in / bytes_out AS ratio FROM bench) SELECT {s4('max(ratio)')} AS best, {s4('min(ratio)')} AS "
    f"worst, {s4('avg(ratio)')} AS mean, arg_max(name, ratio) AS best_name, arg_min(name, ratio) AS worst_name FROM r"
))
def compression_summary(spark, sf):
    d = T.compression_summary(_bench(spark, sf))
    return d.select(*[r4(F.col(k)).alias(k) for k in ("best", "worst", "mean")], "best_name", "worst_name")


@query("memory_summary", (
    f"WITH {_BENCH} SELECT {s4('max(memory)')} AS peak, {s4('avg(memory)')} AS mean, {s4('min(memory)')} AS least, "
    f"{s4('max(memory) / (sum(pixels) / 1e6)')} AS peak_per_megapixel FROM bench"
))
def memory_summary(spark, sf):
    d = T.memory_summary(_bench(spark, sf))
    return d.select(*[r4(F.col(k)).alias(k) for k in d.columns])


@query("batch_summary", (
    f"WITH {_BENCH} SELECT count(*) AS files, {s4('sum(bytes_in)')} AS bytes_in, round(sum(bytes_out), 1) AS bytes_out, "
    f"{s4('avg(bytes_in / bytes_out)')} AS mean_ratio FROM bench"
))
def batch_summary(spark, sf):
    d = T.batch_summary(_bench(spark, sf))
    return d.select("files", r4(F.col("bytes_in")).alias("bytes_in"), F.round("bytes_out", 1).alias("bytes_out"),
        r4(F.col("mean_ratio")).alias("mean_ratio"))


@query("stage_profile", (
    f"SELECT event_type AS stage, {s4('sum(value)')} AS total, count(*) AS calls, {s4('avg(value)')} AS mean, "
    f"{s4('sum(value) / (SELECT sum(value) FROM events)')} AS share FROM events GROUP BY 1 ORDER BY sum(value) DESC, 1 LIMIT 3"
))
def stage_profile(spark, sf):
    d = T.stage_profile(R.table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds")))
    return d.select("stage", r4(F.col("total")).alias("total"), "calls", r4(F.col("mean")).alias("mean"), r4(F.col("share")).alias("share"))


@query("profile_merge", f"SELECT event_type AS stage, {s4('sum(value)')} AS total, count(*) AS calls, {s4('avg(value)')} AS mean FROM events GROUP BY 1")
def profile_merge(spark, sf):
    e = R.table(spark, sf, "events")
    part = lambda w: e.where(w).groupBy(F.col("event_type").alias("stage")).agg(F.sum("value").alias("total"),
        F.count(F.lit(1)).alias("calls"))
    d = T.merge_profiles(part("event_id % 2 = 0"), part("event_id % 2 = 1"))
    return d.select("stage", r4(F.col("total")).alias("total"), "calls", r4(F.col("mean")).alias("mean"))


_NOW = (
    "cur AS (SELECT name, seconds, pixels, bytes_in / bytes_out AS ratio FROM bench), base AS (SELECT name, seconds * (CASE WHEN name LIKE "
    "'%1' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END) AS seconds, pixels, ratio * (CASE WHEN name LIKE '%2' THEN 1.3::DOUBLE ELSE 1.0::DOUBLE "
    "END) AS ratio FROM cur)"
)


def _now_and_base(spark, sf):
    now = _bench(spark, sf).select("name", "seconds", "pixels", (F.col("bytes_in") / F.col("bytes_out")).alias("ratio"))
    base = now.select("name", (F.col("seconds") * F.when(F.col("name").endswith("1"), 0.8).otherwise(1.0)).alias("seconds"), "pixels",
        (F.col("ratio") * F.when(F.col("name").endswith("2"), 1.3).otherwise(1.0)).alias("ratio"))
    return now, base


@query("regressions", (
    f"WITH {_BENCH}, {_NOW} SELECT name, 'time' AS metric, {s4('b.seconds')} AS before, {s4('n.seconds')} AS after, "
    f"{s4('n.seconds / b.seconds - 1')} AS change FROM cur n JOIN base b USING (name) WHERE n.seconds / b.seconds > 1.1 UNION ALL SELECT "
    f"name, 'ratio', {s4('b.ratio')}, {s4('n.ratio')}, {s4('b.ratio / n.ratio - 1')} FROM cur n JOIN base b USING (name) WHERE b.ratio / "
    f"n.ratio > 1.1"
))
def regressions(spark, sf):
    d = T.regressions(*_now_and_base(spark, sf))
    return d.select("name", "metric", *[r4(F.col(k)).alias(k) for k in ("before", "after", "change")])


@query("throughput_gate", f"WITH {_BENCH}, {_NOW} SELECT name, n.pixels / n.seconds >= b.pixels / b.seconds * 0.9 AS passed FROM cur n JOIN base b USING (name)")
def throughput_gate(spark, sf):
    return T.throughput_gate(*_now_and_base(spark, sf)).select("name", "passed")


_EST = (
    "est AS (SELECT name, category, seconds, ratio, CASE WHEN ratio <= 1 THEN 50 WHEN ratio <= 2 THEN 45 WHEN ratio <= 5 THEN 40 WHEN "
    "ratio <= 10 THEN 35 WHEN ratio <= 20 THEN 30 ELSE 25 END::DOUBLE AS psnr FROM (SELECT name, category, seconds, bytes_in / bytes_out "
    "AS ratio FROM bench)), ess AS (SELECT *, greatest(0, least(1, 1 - pow(10, -(psnr - 20) / 20))) AS ssim, greatest(0, 15 - psnr / 3) AS "
    "distance FROM est)"
)


def _estimates(spark, sf):
    d = _bench(spark, sf).select("name", "category", "seconds", (F.col("bytes_in") / F.col("bytes_out")).alias("ratio"))
    d = d.withColumn("psnr", T.estimated_psnr(F.col("ratio")))
    return d.withColumn("ssim", T.estimated_ssim(F.col("psnr"))).withColumn("distance", T.estimated_distance(F.col("psnr")))


@query("estimated_quality", f"WITH {_BENCH}, {_EST} SELECT name, psnr, {s4('ssim')} AS ssim, {s4('distance')} AS distance FROM ess")
def estimated_quality(spark, sf):
    return _estimates(spark, sf).select("name", "psnr", r4(F.col("ssim")).alias("ssim"), r4(F.col("distance")).alias("distance"))


_VAL = (
    "val AS (SELECT *, psnr >= 38 AND ssim >= 0.85 AND seconds <= 5000 AS passed, concat_ws(',', CASE WHEN psnr < 38 THEN 'psnr' END, CASE "
    "WHEN ssim < 0.85 THEN 'ssim' END, CASE WHEN seconds > 5000 THEN 'time' END) AS reasons FROM ess)"
)


@query("validation_flags", f"WITH {_BENCH}, {_EST}, {_VAL} SELECT name, passed, reasons FROM val")
def validation_flags(spark, sf):
    return T.validate(_estimates(spark, sf), 38.0, 0.85, 5000.0).select("name", "passed", "reasons")


@query("validation_summary", (
    f"WITH {_BENCH}, {_EST}, {_VAL} SELECT category, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, "
    f"{s4('avg(psnr)')} AS mean_psnr, {s4('avg(ssim)')} AS mean_ssim, {s4('avg(seconds)')} AS mean_seconds FROM val GROUP BY 1"
))
def validation_summary(spark, sf):
    d = T.validation_summary(T.validate(_estimates(spark, sf), 38.0, 0.85, 5000.0), "category")
    return d.select("category", *longs("passed", "failed"), *[r4(F.col(k)).alias(k) for k in ("mean_psnr", "mean_ssim", "mean_seconds")])


@query("json_report", (
    f"WITH {_BENCH} SELECT category, '{{\"category\":\"' || category || '\",\"results\":[' || string_agg('{{\"name\":\"' || name || "
    f"'\",\"bytes\":' || CAST(floor(bytes_out) AS BIGINT) || '}}', ',' ORDER BY name) || ']}}' AS report FROM bench GROUP BY 1"
))
def json_report(spark, sf):
    return T.json_report(_bench(spark, sf))


@query("html_report", (
    f"WITH {_BENCH} SELECT category, '<table>' || string_agg('<tr><td>' || name || '</td><td>' || CAST(floor(bytes_out) AS BIGINT) || "
    f"'</td></tr>', '' ORDER BY name) || '</table>' AS html FROM bench GROUP BY 1"
))
def html_report(spark, sf):
    return T.html_table(_bench(spark, sf))


@query("byte_sizes", (
    "SELECT event_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN (n * 10 // 1024) // 10 || '.' || (n * 10 // 1024) % 10 || ' "
    "KB' ELSE (n * 10 // 1048576) // 10 || '.' || (n * 10 // 1048576) % 10 || ' MB' END AS size FROM (SELECT event_id, event_id * 997 AS n "
    "FROM events)"
))
def byte_sizes(spark, sf):
    return R.table(spark, sf, "events").select("event_id", S.byte_size(F.col("event_id") * 997).alias("size"))


@query("series_check", "SELECT user_id AS series, count(*) AS frames, count(DISTINCT event_type) = 1 AS uniform FROM events GROUP BY 1")
def series_check(spark, sf):
    d = R.table(spark, sf, "events").select(F.col("user_id").alias("series"), F.lit(16).alias("width"), F.lit(16).alias("height"),
        F.lit(1).alias("channels"), F.col("event_type").alias("kind"))
    return T.series_checks(d)


@query("frame_check", (
    "SELECT event_id, CASE WHEN event_id % 300000 NOT BETWEEN 1 AND 262144 THEN 'width' WHEN event_id % 7 = 0 THEN 'height' WHEN event_id "
    "% 6 NOT BETWEEN 1 AND 4 THEN 'channels' WHEN [8, 10, 12, 16][event_id % 4 + 1] NOT IN (8, 12, 16, 32) THEN 'bits' END AS failed FROM "
    "events"
))
def frame_check(spark, sf):
    d = R.table(spark, sf, "events").select("event_id", (F.col("event_id") % 300000).alias("width"), (F.col("event_id") % 7).alias("height"),
        (F.col("event_id") % 6).alias("channels"),
            F.element_at(F.array(*map(F.lit, (8, 10, 12, 16))), (F.col("event_id") % 4 + 1).cast("int")).alias("bits"))
    return T.frame_checks(d).select("event_id", "failed")
