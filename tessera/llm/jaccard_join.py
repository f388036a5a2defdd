"""N-gram Jaccard join with Bayesian candidate pruning.

Texts with equal shingle sets form a class, of which one row stands for all. Classes that agree in a band of MinHash
values form a group and are each other's candidates; groups with the same members are one. A pair of classes is compared
in the first group that has both, so once. Groups are dealt in blocks of bounded rows and bytes, and a task compares two
blocks: no pair is a row. There, the MinHash values of a class are compared with all others a step at a time, and a pair
is dropped as soon as the posterior probability that its similarity reaches the threshold, given the matches so far and
a uniform prior, falls below `TOLERANCE`. The pairs left are counted exactly on their shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, LOWER, bounded, column, counts_between, documents, fresh, materialize, release, row_id, slices, small, span_hashes, text_bytes, word_bounds, trimmed

WORDS, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 agrees in no band with a chance of (1 - 0.8**6)**40 = 5e-6.
BANDS, ROWS = 40, 6
STEP = 24
TOLERANCE = 1e-6
#: Classes of a group that are compared with those of another block by one task, and the bytes of their shingle sets.
BLOCK, BLOCK_BYTES = 256, 2 << 20

_A = (np.random.default_rng(20).integers(1 << 31, size=BANDS * ROWS, dtype=np.uint32) << 1) | 1
_B = np.random.default_rng(21).integers(1 << 32, size=BANDS * ROWS, dtype=np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's distinct shingles in ascending order, and the texts' offsets in them. A text of one to
    four words has one shingle, of all its words; one without words has none."""
    data = LOWER[data]
    starts, ends = word_bounds(data, offsets)
    n = counts_between(starts, offsets)
    h = span_hashes(data, starts, ends)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    with np.errstate(over="ignore"):
        multiplier = np.uint64(0x9E3779B97F4A7C15)
        key, open_ = h.copy(), np.ones(len(h), bool)
        for j in range(1, WORDS):
            nxt = np.zeros(len(h), np.uint64)
            nxt[:-j or None] = h[j:]
            inside = place + j < n[doc]
            key = np.where(inside, (key ^ (key >> np.uint64(29))) * multiplier + nxt, key)
            open_ &= inside
        key ^= key >> np.uint64(32)
    keep = open_ | ((place == 0) & (n[doc] < WORDS))
    key, doc = key[keep], doc[keep]
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[new], np.searchsorted(doc[new], np.arange(len(offsets)))


def min_hashes(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """BANDS * ROWS MinHash values of each set, a row each; of an empty set, zeros."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, len(_A)), np.uint32)
    if len(full):
        x = (sets ^ (sets >> np.uint64(32))).astype(np.uint32)
        starts = at[:-1][full]
        with np.errstate(over="ignore"):
            for i in range(len(_A)):
                y = x * _A[i]
                y ^= y >> np.uint32(15)
                y *= _B[i] | np.uint32(1)
                out[full, i] = np.minimum.reduceat(y, starts)
    return out


@cache
def least_matches(step: int = STEP, similarity: float = SIMILARITY, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n values, the fewest matches with which a pair lives on. With a uniform prior the posterior is
    Beta(m + 1, n - m + 1), and its tail above the threshold is a binomial sum."""
    out, t = {}, similarity
    for n in range(step, len(_A) + 1, step):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band's values."""
    keys = np.zeros((len(sig), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + sig[:, r::ROWS].astype(np.uint64) + np.uint64(1)
    return keys


class Block(NamedTuple):
    """Classes to compare: ids, rows of each class, MinHash values, shingle sets, and the keys of the earlier bands, in
    which a pair that agrees has been compared (with `met` apart for bands whose groups are not dealt)."""

    ids: list[int]
    sizes: np.ndarray
    sig: np.ndarray
    sets: list[np.ndarray]
    earlier: np.ndarray
    met: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple], band: int) -> Block:
        """From rows (id, size, mask of the bands dealt, MinHash values, shingle set)."""
        sig = np.array([r[3] for r in rows])
        met = (np.array([r[2] for r in rows], np.int64)[:, None] >> np.arange(band)) & 1 == 1
        return cls([r[0] for r in rows], np.array([r[1] for r in rows], np.int64), sig, [r[4] for r in rows], band_keys(sig)[:, :band], met)


def similar(a: Block, b: Block) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a, the rows of b (after it, if they are the same block) with a similarity that reaches SIMILARITY,
    but for pairs that agree in an earlier band."""
    least = least_matches()
    sets_b = b.sets
    sizes = np.array([len(s) for s in sets_b])
    values, numbers = np.unique(np.concatenate(sets_b), return_inverse=True)
    ends = np.cumsum(sizes)
    marked = np.zeros(len(values), bool)
    for i, s in enumerate(a.sets):
        alive = np.arange(i + 1 if a is b else 0, len(sets_b))
        short, long = np.minimum(sizes[alive], len(s)), np.maximum(sizes[alive], len(s))
        alive = alive[short >= SIMILARITY * long - 1e-9]  # no overlap can be enough otherwise
        alive = alive[~((b.earlier[alive] == a.earlier[i]) & b.met[alive] & a.met[i]).any(axis=1)]
        matches = np.zeros(len(alive), np.int64)
        for n, m in least.items():
            matches += (b.sig[alive, n - STEP : n] == a.sig[i, n - STEP : n]).sum(axis=1)
            lives = matches >= m
            alive, matches = alive[lives], matches[lives]
            if not len(alive):
                break
        if not len(alive):
            continue
        own = np.searchsorted(values, s)
        own = own[(own < len(values)) & (values[np.minimum(own, len(values) - 1)] == s)]
        marked[own] = True
        lengths = sizes[alive]
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        flat = np.repeat(ends[alive] - lengths - first, lengths) + np.arange(lengths.sum())
        shared = np.add.reduceat(marked[numbers[flat]].astype(np.int64), first)
        marked[own] = False
        hit = alive[shared >= SIMILARITY * (len(s) + lengths - shared) - 1e-9]
        if len(hit):
            yield i, hit


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, component (its smallest node) of all nodes in edges (a, b), by alternating large-star and small-star steps:
    each step's rows are at most those of the edges, and the tables of the steps are written to the shared folder. The
    nodes' smallest neighbours are broadcast while the edges, at least half as many, are few; beyond, they are written,
    so that a join deals both its sides and can split the star of a node with many edges."""
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before, few = None, edges.count() <= BROADCAST_ROWS // 2
    dealt = lambda low: F.broadcast(low) if few else materialize(low, name)
    while True:
        near = both(edges)
        low = dealt(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = near.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = dealt(down.groupBy("a").agg(F.min("b").alias("m")))
        shrunk = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"),
            F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        old, edges = edges, materialize(shrunk.distinct(), name)
        release(old)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"),
        F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


_SIGNED = "row long, k long, hash binary, n int, bands array<long>"


def _sign(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                sets, at = shingle_sets(*text_bytes(part.column("t")))
                keys = band_keys(min_hashes(sets, at))
                whole = [xxhash.xxh3_128_digest(sets[at[i] : at[i + 1]].tobytes()) for i in range(len(part))]
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("k"), pa.array(whole, pa.binary()),
                    pa.array(np.diff(at), pa.int32()), bands], names=["row", "k", "hash", "n", "bands"])

    return rows.mapInArrow(trimmed(run), _SIGNED)


_DEALT = "band int, value long, x int, y int, block int, row long, size long, mask long, sig binary, shingles binary"


def _deal(members: DataFrame) -> DataFrame:
    """From rows (row, size, mask, groups [(band, value, blocks)], t): one for each pair of blocks that the class is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _DEALT.split(", ")]
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        for batch in batches:
            for part in slices(batch, "t"):
                sets, at = shingle_sets(*text_bytes(part.column("t")))
                sig = min_hashes(sets, at)
                out, held = [], 0
                for i, (row, size, mask, groups) in enumerate(zip(*(part.column(c).to_pylist() for c in ("row", "size", "mask", "groups")),
                    strict=True)):
                    body = sig[i].tobytes(), sets[at[i] : at[i + 1]].tobytes()
                    for g in groups:
                        own = (row ^ g["value"]) % g["blocks"]
                        for o in range(g["blocks"]):
                            out.append((g["band"], g["value"], min(own, o), max(own, o), own, row, size, mask, *body))
                            held += len(body[1])
                            if held > 1 << 24:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                    names=names)
                                out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return members.mapInArrow(trimmed(run), _DEALT)


def _compare(blocks: DataFrame) -> DataFrame:
    """From the rows of _deal, those of one (band, value, x, y) together: for each row with links, `links` (the rows of all
    classes linked to it), and edges (row, other) of a spanning forest of the blocks' links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def done() -> Iterator[pa.RecordBatch]:
            band, _, x, y = key
            a = Block.of([h[1:] for h in held if h[0] == x], band)
            b = a if x == y else Block.of([h[1:] for h in held if h[0] == y], band)
            links: dict[int, int] = {}
            root = {r: r for r in (*a.ids, *b.ids)}

            def find(v: int) -> int:
                while root[v] != v:
                    root[v] = root[root[v]]
                    v = root[v]
                return v

            count_b = np.zeros(len(b.ids), np.int64)
            edges = []
            for i, hit in similar(a, b):
                links[a.ids[i]] = links.get(a.ids[i], 0) + int(b.sizes[hit].sum())
                count_b[hit] += a.sizes[i]
                for j in hit.tolist():
                    u, v = find(a.ids[i]), find(b.ids[j])
                    if u != v:
                        root[max(u, v)] = min(u, v)
                        edges.append((a.ids[i], b.ids[j]))
            for j in np.flatnonzero(count_b).tolist():
                links[b.ids[j]] = links.get(b.ids[j], 0) + int(count_b[j])
            rows = [(r, None, n) for r, n in links.items()] + [(u, v, 0) for u, v in edges]
            if rows:
                u, v, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())],
                    names=["row", "other", "links"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("band", "value", "x", "y", "block", "row", "size", "mask")]
            for *own, block, row, size, mask, sig, shingles in zip(*columns, batch.column("sig"), batch.column("shingles"), strict=True):
                if own != key:
                    if len(held) > 1 and len({h[0] for h in held}) == (1 if key[2] == key[3] else 2):
                        yield from done()
                    key, held = own, []
                held.append((block, row, size, mask, np.frombuffer(sig.as_py(), np.uint32), np.frombuffer(shingles.as_py(), np.uint64)))
        if len(held) > 1 and len({h[0] for h in held}) == (1 if key[2] == key[3] else 2):
            yield from done()

    return blocks.mapInArrow(trimmed(run), "row long, other long, links long")


def join(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, class_id, group_id and n_links, a row for each row of docs.

    class_id is the smallest doc_id among the rows with the same shingle set, group_id that among all rows linked to it,
    directly or through others, and n_links the number of other rows with a similarity of SIMILARITY or more, copies
    included. Shingles are of lower-cased (A-Z) words. Null and empty texts have no shingles: they share a class, but
    have no links, and each is a group of its own (class_id and group_id are then its own doc_id). Repeated rows are
    rows of their own; null keys take part, and ids are taken from the others of their group. Other columns are not
    read. An empty table gives no rows.
    """
    signed, per_class = _linked(docs, text, key)
    out = signed.where("n > 0").select("k", "hash").join(per_class, "hash", "left")
    out = out.select(F.col("k").alias("doc_id"), "class_id", "group_id", F.col("n_links").cast("long").alias("n_links"))
    bare = signed.where("n = 0").select(F.col("k").alias("doc_id"), F.col("k").alias("class_id"), F.col("k").alias("group_id"),
        F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(bare)


def _linked(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """The signed rows (row, k, hash, n, bands), and per class hash, class_id, group_id, n_links and `stays`, the row with
    the smallest key of the whole group."""
    bounded(docs.sparkSession)
    rows = docs.select(column(key).cast("long").alias("k"), column(text).alias("t"), row_id(text, key).alias("row"))
    signed = materialize(_sign(rows), "jaccard-signed")
    last = 2**63 - 1  # stands for a null key, so that the others come first
    one = F.min(F.struct(F.coalesce("k", F.lit(last)).alias("k"), "row", "n", "bands")).alias("one")
    classes = signed.where("n > 0").groupBy("hash").agg(one, F.count(F.lit(1)).alias("size"))
    classes = materialize(classes.select("hash", "size", "one.*"), "jaccard-classes")
    # groups: their members' number and two sums of hashes tell which have the same ones
    bands = classes.select("row", "n", F.posexplode("bands").alias("band", "value"))
    groups = bands.groupBy("band", "value").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("n").cast("long")).alias("n"),
        F.bit_xor(F.xxhash64("row")).alias("p"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("q"))
    blocks = F.ceil(F.greatest(F.col("c") / BLOCK, F.col("n") * 8 / BLOCK_BYTES)).cast("int")
    groups = groups.where("c > 1").groupBy("c", "n", "p", "q").agg(F.min(F.struct("band", "value")).alias("g")).select("g.*", blocks.alias("blocks"))
    groups = materialize(groups, "jaccard-groups")
    members = bands.join(small(groups), ["band", "value"]).groupBy("row").agg(F.collect_list(F.struct("band", "value", "blocks")).alias("groups"),
        F.bit_or(F.expr("shiftleft(1L, band)")).alias("mask"))
    members = materialize(members.join(classes.select("row", "size"), "row"), "jaccard-members")
    texts = rows.join(small(members.select("row")), "row", "left_semi").dropDuplicates(["row"])
    dealt = _deal(texts.join(members, "row").select("row", "size", "mask", "groups", "t"))
    own = ["band", "value", "x", "y"]
    found = materialize(_compare(dealt.repartition(*own).sortWithinPartitions(*own, "block", "row")), "jaccard-links")
    linked = components(found.where("other IS NOT NULL").select(F.col("row").alias("a"), F.col("other").alias("b")), "jaccard-components")
    ids = linked.join(classes.select(F.col("row").alias("node"), "k"), "node")
    firsts = materialize(ids.groupBy("component").agg(F.min(F.struct("k", F.col("node").alias("row"))).alias("first")), "jaccard-firsts")
    per_row = linked.join(small(firsts), "component").select(F.col("node").alias("row"), "first")
    counted = found.where("other IS NULL").groupBy("row").agg(F.sum("links").alias("links"))
    per_class = classes.join(per_row, "row", "left").join(counted, "row", "left")
    none = lambda c: F.when(c < last, c)
    return signed, per_class.select(
        "hash", none(F.col("k")).alias("class_id"), none(F.coalesce("first.k", "k")).alias("group_id"),
        (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("first.row", "row").alias("stays"),
    )


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each group of linked rows, the one with the smallest key; null keys come last, and of rows
    equal in key and text one stays. Null texts and those without words have no links: all their rows stay. Columns of
    any names pass through. An empty table gives no rows."""
    signed, per_class = _linked(docs, text, key)
    row = fresh(docs, "row")
    rows = signed.where("n > 0").join(per_class.select("hash", "stays"), "hash")
    lost = materialize(rows.where("row <> stays").select(F.col("row").alias(row)).distinct(), "jaccard-lost")
    left = docs.withColumn(row, row_id(text, key)).join(small(lost), row, "left_anti")
    twice = materialize(signed.where("n > 0").groupBy("row").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("row").alias(row)),
        "jaccard-twice")
    if twice.limit(1).count():
        left = left.join(small(twice), row, "left_anti").unionByName(left.join(small(twice), row, "left_semi").dropDuplicates([row]))
    return left.select(*map(column, docs.columns))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))


OP10_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + {WORDS - 1}], ' ')) AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 2}, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) GROUP BY ALL)
          JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE c >= {SIMILARITY} * (p.n + q.n - c) - 1e-9),
same AS (SELECT a, min(b) AS class_id FROM (SELECT a, b, count(*) AS c FROM (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y USING (g)) GROUP BY ALL)
         JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE c = p.n AND c = q.n GROUP BY a),
reach AS (SELECT a, b FROM links),
r2 AS (SELECT DISTINCT x.a, y.b FROM reach x JOIN reach y ON x.b = y.a),
r4 AS (SELECT DISTINCT x.a, y.b FROM r2 x JOIN r2 y ON x.b = y.a),
r8 AS (SELECT DISTINCT x.a, y.b FROM r4 x JOIN r4 y ON x.b = y.a),
g AS (SELECT a, min(b) AS group_id FROM r8 GROUP BY a),
l AS (SELECT a, count(*) - 1 AS n_links FROM links GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(group_id, doc_id) AS group_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM documents LEFT JOIN same ON same.a = doc_id LEFT JOIN g ON g.a = doc_id LEFT JOIN l ON l.a = doc_id
"""
