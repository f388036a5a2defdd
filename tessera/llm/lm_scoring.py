"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions; each has, in every context of 0 to `DEPTH` preceding bytes, a Krichevsky-Trofimov (KT)
estimate from the training texts' counts, and a decision's probability mixes the estimates along its context path with
the weights of context-tree weighting: half for a node's own estimate, half for the product of its children.

The counts are one aggregation over all training texts (grams of DEPTH + 1 bytes, summed up in Spark). The tree holds every
context seen in training, as a table for each depth with a row a context and decision: sums go up the tree by groupings,
mixtures down it by joins. The grams that occur most often, at most `GRAMS`, are looked up where the text is read; the
others, and those not seen in training, join their probabilities by a shuffle of (row, gram, times). What is broadcast is
a cache: its size changes no score.

The unigram base needs the counts of all words: the words that occur most often, at most `COMMON`, are looked up where
the text is read, the others join their counts by a shuffle of (row, word, times).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, bounded, counts_between, documents, materialize, slices, span_hashes, text_bytes, word_bounds

DEPTH = 4
GRAMS = 1_000_000
#: Contexts of a tree held by one process, see `tree_of`.
CONTEXTS = 12_000
COMMON = 500_000
#: Distinct keys held by a task between two of its partial sums.
HELD = 1_500_000
#: The key of the end token; words hash elsewhere but for one chance in 2**64.
END_KEY = np.uint64(0x5EED_0E4D_0E4D_5EED)


class Sums:
    """Counts by 64-bit key with a bounded number of keys in memory."""

    def __init__(self):
        self._keys, self._n, self._size = [], [], 0

    def add(self, keys: np.ndarray, n: np.ndarray | None = None) -> None:
        if n is None:
            keys, n = np.unique(keys, return_counts=True)
        self._keys.append(keys)
        self._n.append(n.astype(np.int64))
        self._size += len(keys)

    def full(self) -> bool:
        """After merging what it holds, if that was much."""
        if self._size > HELD:
            self._merge()
        return self._size > HELD // 2

    def _merge(self) -> None:
        keys = np.concatenate(self._keys) if self._keys else np.zeros(0, np.uint64)
        n = np.concatenate(self._n) if self._n else np.zeros(0, np.int64)
        keys, at = np.unique(keys, return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, at, n)
        self._keys, self._n, self._size = [keys], [total], len(keys)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        out = self._keys[0], self._n[0]
        self._keys, self._n, self._size = [], [], 0
        return out


def grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """For each byte, the bytes before it and itself as an integer, itself lowest; before a text's start, zeros."""
    at = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = data.astype(np.uint64)
    for j in range(1, depth + 1):
        before = np.zeros(len(data), np.uint64)
        before[j:] = data[:-j]
        before[at < j] = 0
        out |= before << np.uint64(8 * j)
    return out


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = word_bounds(data, offsets)
    return span_hashes(data, starts, ends), counts_between(starts, offsets)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def count(docs: DataFrame, depth: int) -> DataFrame:
    """kind (0 word, 1 gram), key, n over the training rows of docs (held, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(), Sums()

        def rows(kind: int) -> Iterator[pa.RecordBatch]:
            keys, n = sums[kind].take()
            for i in range(0, len(keys), 100_000):
                k = keys[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), _signed(k), pa.array(n[i : i + 100_000])],
                    names=["kind", "key", "n"])

        for batch in batches:
            for part in slices(batch.filter(pa.array(~np.asarray(batch.column("held")))), "t"):
                data, offsets = text_bytes(part.column("t"))
                data = LOWER[data]
                sums[0].add(np.concatenate([_words(data, offsets)[0], np.full(len(part), END_KEY)]))
                sums[1].add(grams(data, offsets, depth))
                for kind in (0, 1):
                    if sums[kind].full():
                        yield from rows(kind)
        for kind in (0, 1):
            yield from rows(kind)

    return docs.select("held", "t").mapInArrow(run, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _least(counts: DataFrame, most: int) -> float:
    """The smallest n for which at most `most` rows have as many; found on a histogram of a thousand classes at most."""
    classes = counts.groupBy(F.floor(F.log2("n") * 16).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("c")).collect()
    total, least = 0, float("inf")
    for r in classes:
        total += r.rows
        if total > most:
            break
        least = 2.0 ** (r.c / 16)
    return least


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series at x + 8, taken back by the recurrence."""
    down = np.zeros_like(x)
    for i in range(8):
        down += np.log(x + i)
    y = x + 8
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - down


def _decisions(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of zeros and of ones at the 255 decisions of each row of 256 symbol counts: level by level, from the top bit."""
    zeros, ones = [], []
    for level in range(8):
        halves = symbols.reshape(len(symbols), 1 << level, 2, 1 << (7 - level)).sum(axis=3)
        zeros.append(halves[:, :, 0])
        ones.append(halves[:, :, 1])
    return np.concatenate(zeros, axis=1), np.concatenate(ones, axis=1)


def _log_bytes(p_one: np.ndarray) -> np.ndarray:
    """log10 probabilities of the 256 bytes from those of a one at the 255 decisions."""
    out = np.zeros((len(p_one), 1))
    first = 0
    for level in range(8):
        p = p_one[:, first : first + (1 << level)]
        first += 1 << level
        out = (out[:, :, None] + np.log10(np.stack([1 - p, p], axis=2))).reshape(len(p), -1)
    return out


class Tree:
    """Context tree over kept contexts. Nodes are numbered by depth; the children of a node that aren't kept are one leaf
    together, the node's rest. leaf[node, byte before] is the next node, or -1 - row where the walk ends."""

    def __init__(self, depth: int, contexts: np.ndarray, depths: np.ndarray, symbols: np.ndarray):
        """symbols[i] holds the counts of the 256 bytes after context i; contexts are integers, the last byte lowest."""
        self.depth = depth
        order = np.lexsort((contexts, depths))
        contexts, depths, symbols = contexts[order], depths[order], symbols[order]
        n = len(contexts)
        by = {(int(d), int(c)): i for i, (d, c) in enumerate(zip(depths, contexts, strict=True))}
        parent = np.full(n, -1)
        for (d, c), i in by.items():
            if d:
                parent[i] = by[d - 1, c & ((1 << 8 * (d - 1)) - 1)]
        inner = np.flatnonzero(depths < depth)
        rest = symbols[inner].astype(np.float64)
        row_of_rest = np.full(n, -1)
        row_of_rest[inner] = np.arange(len(inner))
        has = parent >= 0
        np.subtract.at(rest, row_of_rest[parent[has]], symbols[has])
        kt = lambda z, o: _lgamma(z + 0.5) + _lgamma(o + 0.5) - _lgamma(z + o + 1.0) - np.log(np.pi)
        # upward: log P_w of each node and decision
        z, o = _decisions(symbols.astype(np.float64))
        own = kt(z, o)
        below = kt(*_decisions(rest))  # the product over the children starts with the rest's
        weighted = own.copy()
        for d in range(depth, -1, -1):
            level = np.flatnonzero(depths == d)
            if d < depth and len(level):
                weighted[level] = np.logaddexp(own[level], below[row_of_rest[level]]) - np.log(2)
            if d and len(level):
                np.add.at(below, row_of_rest[parent[level]], weighted[level])
        # downward: what the estimates mix to along the path, and the share left for deeper nodes
        mixed, left = np.zeros((n, 255)), np.ones((n, 255))
        estimate = (o + 0.5) / (z + o + 1)
        for d in range(depth + 1):
            level = np.flatnonzero(depths == d)
            if not len(level):
                continue
            if d:
                mixed[level], left[level] = mixed[parent[level]], left[parent[level]]
            share = np.exp(own[level] - np.log(2) - weighted[level]) if d < depth else 1.0
            mixed[level] += left[level] * share * estimate[level]
            left[level] *= 1 - share
        rz, ro = _decisions(rest)
        rest_p = mixed[inner] + left[inner] * (ro + 0.5) / (rz + ro + 1)
        leaves = np.flatnonzero(depths == depth)
        tiny = 1e-12
        self.rows = _log_bytes(np.clip(np.concatenate([rest_p, mixed[leaves]]), tiny, 1 - tiny)).astype(np.float32)
        self.step = np.full((max(1, len(inner)), 256), 0, np.int32)
        self.step[:] = (-1 - np.arange(len(inner)))[:, None] if len(inner) else -1
        row_of_leaf = np.full(n, -1)
        row_of_leaf[leaves] = len(inner) + np.arange(len(leaves))
        for i in np.flatnonzero(has):
            before = int(contexts[i]) >> 8 * (int(depths[i]) - 1)
            self.step[parent[i], before] = i if depths[i] < depth else -1 - row_of_leaf[i]

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's lowest byte after the others."""
        node = np.zeros(len(gram), np.int32)
        flat, rows = self.step.ravel(), self.rows.ravel()
        live = np.arange(len(gram))
        for j in range(1, self.depth + 1):
            before = ((gram[live] >> np.uint64(8 * j)) & np.uint64(255)).astype(np.int64)
            node[live] = flat[(node[live].astype(np.int64) << 8) | before]
            live = live[node[live] >= 0]
            if not len(live):
                break
        row = -1 - node.astype(np.int64)
        return rows[(row << 8) | (gram & np.uint64(255)).astype(np.int64)]


def tree_of(counts: DataFrame, depth: int = DEPTH, most: int = CONTEXTS) -> Tree:
    """The tree of the corpus' gram counts in one process, of at most `most` contexts: for small corpora. `score` doesn't
    use it; where `most` is not reached it gives the same probabilities."""
    by_depth = counts.where("kind = 1").selectExpr("key", "n", f"explode(sequence(0, {depth})) AS d")
    ctx = F.expr("shiftrightunsigned(key, 8) & (shiftleft(1L, 8 * d) - 1)")
    by_depth = by_depth.select("d", ctx.alias("ctx"), F.expr("CAST(key & 255 AS INT)").alias("sym"), "n")
    contexts = by_depth.groupBy("d", "ctx").agg(F.sum("n").alias("n"))
    least = _least(contexts, most)
    kept = contexts.where(F.col("n") >= least).select("d", "ctx").collect()
    keys = sorted({(r.d, r.ctx) for r in kept} | {(0, 0)})
    asked = counts.sparkSession.createDataFrame(keys, "d int, ctx long")
    found = by_depth.join(F.broadcast(asked), ["d", "ctx"]).groupBy("d", "ctx", "sym").agg(F.sum("n").alias("n")).toArrow()
    at = {k: i for i, k in enumerate(keys)}
    symbols = np.zeros((len(keys), 256), np.float64)
    for d, c, s, n in zip(*(found.column(x).to_pylist() for x in ("d", "ctx", "sym", "n")), strict=True):
        symbols[at[d, c], s] = n
    return Tree(depth, np.array([c for _, c in keys], np.int64), np.array([d for d, _ in keys]), symbols)


def _log_gamma(x: Column) -> Column:
    """As `_lgamma`, on columns."""
    down = x
    for i in range(1, 8):
        down = down * (x + i)
    y = x + 8
    z = 1 / (y * y)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - F.log(down)


def _up(context: str, depth: int) -> Column:
    """The last `depth` bytes of a context."""
    return F.col(context).bitwiseAND(F.lit((1 << 8 * depth) - 1).cast("long"))


def _bits(grams: DataFrame, *others: str) -> DataFrame:
    """ctx, at (the decision, 0 to 254), bit: eight rows for each gram (key)."""
    d = grams.select("key", *others, F.expr("CAST(key & 255 AS INT) AS sym"), F.expr("explode(sequence(0, 7)) AS l"))
    return d.select("key", *others, F.expr("shiftrightunsigned(key, 8) AS ctx"), F.expr("shiftleft(1, l) - 1 + shiftright(sym, 8 - l) AS at"),
        F.expr("shiftright(sym, 7 - l) & 1 AS bit"))


def nodes(counts: DataFrame, depth: int = DEPTH) -> list[DataFrame]:
    """A table for each depth: ctx, at and p, the probability of a one at this decision where the context's last bytes are
    ctx and no deeper context has seen the decision. All contexts and decisions of the training texts have a row."""
    half, levels = math.log(2), {}
    for d in range(depth, -1, -1):
        if d == depth:
            seen = _bits(counts.where("kind = 1"), "n").groupBy("ctx", "at")
            level = seen.agg(F.sum(F.expr("n * (1 - bit)")).alias("z"), F.sum(F.expr("n * bit")).alias("o"), F.lit(0.0).alias("below"))
        else:
            level = levels[d + 1].groupBy(_up("ctx", d).alias("ctx"), "at").agg(F.sum("z").alias("z"), F.sum("o").alias("o"),
                F.sum("weighted").alias("below"))
        z, o = F.col("z").cast("double"), F.col("o").cast("double")
        level = level.withColumn("own", _log_gamma(z + 0.5) + _log_gamma(o + 0.5) - _log_gamma(z + o + 1) - math.log(math.pi))
        mean = F.greatest("own", "below") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("below")))) - half
        levels[d] = materialize(level.withColumn("weighted", mean if d < depth else F.col("own")), f"lm-up-{d}")
    out = []
    for d in range(depth + 1):
        level = levels[d].withColumn("share", F.exp(F.col("own") - half - F.col("weighted")) if d < depth else F.lit(1.0))
        if d:
            parent = out[-1].select(F.col("ctx").alias("up"), "at", "mixed", "left")
            level = level.withColumn("up", _up("ctx", d - 1)).join(F.broadcast(parent) if d < 3 else parent, ["up", "at"])
        else:
            level = level.withColumn("mixed", F.lit(0.0)).withColumn("left", F.lit(1.0))
        mixed = F.col("mixed") + F.col("left") * F.col("share") * (F.col("o") + 0.5) / (F.col("z") + F.col("o") + 1)
        out.append(materialize(level.select("ctx", "at", mixed.alias("mixed"), (F.col("left") * (1 - F.col("share"))).alias("left")), f"lm-down-{d}"))
    return [level.select("ctx", "at", (F.col("mixed") + F.col("left") / 2).alias("p")) for level in out]


def values(grams: DataFrame, tree: list[DataFrame], trained: bool = False) -> DataFrame:
    """key, value: log10 of the probability of each gram's lowest byte after the others, for distinct grams (key). Where all
    of them are `trained`, their full contexts have seen each of their decisions."""
    bits, p = _bits(grams), F.lit(0.5)
    for d in range(len(tree) - 1 if trained else 0, len(tree)):
        level = tree[d].select(F.col("ctx").alias("up"), "at", F.col("p").alias(f"p{d}"))
        bits = bits.withColumn("up", _up("ctx", d)).join(F.broadcast(level) if d < 2 else level, ["up", "at"], "left").drop("up")
        p = F.coalesce(f"p{d}", p)
    tiny = 1e-12
    p = F.greatest(F.lit(tiny), F.least(F.lit(1 - tiny), p))
    return bits.groupBy("key").agg(F.sum(F.log10(F.when(F.col("bit") == 1, p).otherwise(1 - p))).alias("value"))


def _lists(of: np.ndarray, keys: np.ndarray, n: int) -> list[pa.ListArray]:
    """For each of n rows its distinct keys, and how often it has them."""
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (keys[1:] != keys[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(of))).astype(np.int32)
    ends = np.searchsorted(of[first], np.arange(n + 1)).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(ends), x) for x in (_signed(keys[first]), pa.array(times))]


def _sorted(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = found.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found.column(1).to_numpy()[order]


def _find(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted known keys, and whether the key is there."""
    place = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
    return place, known[place] == keys if len(known) else np.zeros(len(keys), bool)


def _pairs(scored: DataFrame, keys: str, times: str) -> DataFrame:
    """row, key, times of the keys that were not looked up."""
    return scored.select("row", F.explode(F.arrays_zip(keys, times)).alias("x")).select("row", F.col(f"x.{keys}").alias("key"),
        F.col(f"x.{times}").alias("times"))


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", depth: int = DEPTH, common: int = COMMON, often_grams: int = GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte, a row for each row.

    Rows whose crc32(key as text) mod 7 is 2 are held out; a null key counts as the empty text, so it is in training.
    A-Z are lower-cased for both models. A null or empty text is the end token alone for the base and has the score 0
    (bits_per_byte null). Repeated rows count in training as often as they occur. Without training rows, N and V are 0.
    Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded(spark)
    held = F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "utf-8")) % 7 == 2
    rows = docs.select(F.col(key).cast("long").alias("k"), held.alias("held"), F.col(text).alias("t"))
    counts = materialize(count(rows, depth), "lm-counts")
    words = counts.where("kind = 0")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    least = _least(words, common)
    often, often_n = _sorted(words.where(F.col("n") >= least).select("key", "n").toArrow())
    tree, trained = nodes(counts, depth), counts.where("kind = 1")
    cached = values(trained.where(F.col("n") >= _least(trained, often_grams)).select("key"), tree, trained=True)
    model = spark.sparkContext.broadcast((_sorted(cached.toArrow()), (often, np.log10(often_n + 1.0))))
    n_all, per_token = int(total.n), float(np.log10(total.n + (total.v + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known_grams, log_p), (known, value) = model.value
        for batch in batches:
            for part in slices(batch, "t"):
                data, offsets = text_bytes(part.column("t"))
                data, n = LOWER[data], len(part)
                at = np.repeat(np.arange(n), np.diff(offsets))
                g = grams(data, offsets, depth)
                distinct, which = np.unique(g, return_inverse=True)
                place, hit = _find(distinct, known_grams)
                p = np.zeros(len(distinct))
                p[hit] = log_p[place[hit]]
                p = np.bincount(at, weights=p[which], minlength=n)
                missed = ~hit[which]
                h, n_words = _words(data, offsets)
                doc = np.concatenate([np.repeat(np.arange(n), n_words), np.arange(n)])
                h = np.concatenate([h, np.full(n, END_KEY)])
                place, hit = _find(h, known)
                base = np.bincount(doc[hit], weights=value[place[hit]], minlength=n) - (n_words + 1) * per_token
                lists = _lists(doc[~hit], h[~hit], n) + _lists(at[missed], g[missed], n)
                columns = [part.column("k"), part.column("held"), pa.array(n_words + 1, pa.int64()),
                    pa.array(np.bincount(doc[hit], minlength=n), pa.int64()), pa.array(base.astype(np.float64)), pa.array(p.astype(np.float64)),
                        pa.array(np.diff(offsets), pa.int64()), *lists]
                yield pa.RecordBatch.from_arrays(columns,
                    names=["k", "held", "n_tokens", "n_known", "base", "p", "n_bytes", "seldom", "times", "grams", "gram_times"])

    scored = rows.mapInArrow(run, (
        "k long, held boolean, n_tokens long, n_known long, base double, p double, n_bytes long, seldom array<long>, times array<int>, "
        "grams array<long>, gram_times array<int>"
    ))
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    rest = words.where(F.col("n") < least).select("key", F.log10(F.col("n") + 1).alias("value"))
    rest = _pairs(scored, "seldom", "times").join(rest, "key").groupBy("row").agg(F.sum("times").alias("more"),
        F.sum(F.col("times") * F.col("value")).alias("more_base"))
    missed = _pairs(scored, "grams", "gram_times")
    missed = missed.join(values(missed.select("key").distinct(), tree),
        "key").groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("more_p"))
    out = scored.drop("seldom", "times", "grams", "gram_times").join(rest, "row", "left").join(missed, "row", "left").withColumn("p",
        F.col("p") + F.coalesce("more_p", F.lit(0.0)))
    return out.select(
        F.col("k").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens",
            (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), F.col("p").alias("score"),
            F.when(F.col("n_bytes") > 0, -F.col("p") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
