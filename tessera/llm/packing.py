"""Best-fit packing with exact-complement hashing.

Only the lengths decide which pieces share a sequence, so the plan is made on the histogram of lengths, of at most
`capacity` entries at any input size: sums of one, two and three lengths are indexed by their counts, a gap that a sum
fills exactly is filled as often as counts allow, and what remains goes to the fullest sequence that has room. The plan's
runs (the same lengths together, so many times) are then dealt to the pieces by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, column, documents, materialize, slices
from .vocab import encoder

CAPACITY, END = 1024, 2
VOCABULARY = "byte_bpe_50k.json"
#: Rows of one length that are ranked together, while there are under a hundred million rows.
RANKED = 1000


class Sums:
    """An index from sums to the combinations of one, two and three lengths in stock, under their counts.

    A pair of sum s is its larger length, a triple of sum s its first length and a pair of the rest. For each sum the
    index holds the largest such length that still has a combination. Stock is only taken out, so a combination that
    runs out never comes back, and each entry only moves down: all look-ups together cost no more than the index.
    """

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.counts = [0] * (capacity + 1)
        for n, c in histogram.items():
            self.counts[n] = c
        self._pair = list(range(-1, capacity))  # of sum s, the larger length, at most s - 1
        self._triple = list(range(-2, capacity - 1))

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for n in lengths:
            self.counts[n] -= times

    def holds(self, lengths: tuple[int, ...]) -> bool:
        return all(self.counts[n] >= lengths.count(n) for n in lengths)

    def times(self, lengths: tuple[int, ...]) -> int:
        return min(self.counts[n] // lengths.count(n) for n in set(lengths))

    def _pairs(self, s: int) -> Iterator[tuple[int, int]]:
        counts, a = self.counts, self._pair[s]
        while 2 * a >= s and not (counts[a] and counts[s - a]):
            a -= 1
        self._pair[s] = a
        while 2 * a >= s > 1:
            if counts[a] and counts[s - a]:
                yield a, s - a
            a -= 1

    def _triples(self, s: int) -> Iterator[tuple[int, int, int]]:
        counts, a = self.counts, self._triple[s]
        while 3 * a >= s and not (counts[a] and any(True for _ in self._pairs(s - a))):
            a -= 1
        self._triple[s] = a
        while 3 * a >= s > 2:
            if counts[a]:
                yield from ((a, *x) for x in self._pairs(s - a))
            a -= 1

    def of(self, s: int, most: int = 3, beside: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """Up to `most` lengths that sum to s and are in stock together with those `beside` them, the fewest first."""
        if s < 1:
            return None
        if self.holds((s, *beside)):
            return (s,)
        for kind in (self._pairs, self._triples)[: most - 1]:
            for found in kind(s):
                if self.holds((*found, *beside)):
                    return found
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Runs of (length: how many in the sequence, sequences), which use each piece of the histogram once."""
    stock = Sums(histogram, capacity)
    counts = stock.counts
    out: list[tuple[dict[int, int], int]] = []
    for most in (1, 2, 3):  # fillings of fewer pieces first: they leave the short ones to the others
        for n in range(capacity, 0, -1):
            while counts[n]:
                more = stock.of(capacity - n, most, (n,)) if n < capacity else ()
                if more is None:
                    break
                lengths = (n, *more)
                times = stock.times(lengths)
                out.append((_grouped(lengths), times))
                stock.take(lengths, times)
    # the residuals: open sequences by gap, and pieces from the longest, each into the smallest gap that holds it
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}
    gaps = np.zeros(capacity + 1, dtype=np.int64)

    def put(bin_: dict[int, int], times: int) -> None:
        gap = capacity - sum(k * v for k, v in bin_.items())
        if gap:
            open_.setdefault(gap, []).append((bin_, times))
            gaps[gap] += times
        else:
            out.append((bin_, times))

    def fill() -> None:
        """What exact complements are left for the open sequences, the fullest first."""
        for gap in np.flatnonzero(gaps).tolist():
            while gaps[gap] and (more := stock.of(gap)):
                bin_, have = open_[gap].pop()
                times = min(have, stock.times(more))
                stock.take(more, times)
                gaps[gap] -= have
                if have > times:
                    put(bin_, have - times)
                out.append((_grouped(more, bin_), times))

    for n in range(capacity, 0, -1):
        while counts[n]:
            room = np.flatnonzero(gaps[n:])
            if not len(room):  # as many new sequences as these pieces need, filled with their like
                each = capacity // n
                if full := counts[n] // each:
                    put({n: each}, full)
                if left := counts[n] % each:
                    put({n: left}, 1)
                counts[n] = 0
                if n > 1:
                    fill()
                break
            gap = n + int(room[0])
            bin_, have = open_[gap].pop()
            fit = min(gap // n, counts[n])
            times = min(have, counts[n] // fit)
            gaps[gap] -= have
            counts[n] -= times * fit
            if have > times:
                put(bin_, have - times)
            put(_grouped((n,) * fit, bin_), times)
    return out + [x for held in open_.values() for x in held]


def _grouped(lengths: tuple[int, ...], into: dict[int, int] | None = None) -> dict[int, int]:
    out = dict(into or {})
    for n in lengths:
        out[n] = out.get(n, 0) + 1
    return out


class Deal:
    """Sequence and offset of the piece with a given rank among those of its length."""

    def __init__(self, runs: list[tuple[dict[int, int], int]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        sequence = 0
        for bin_, times in runs:
            offset = 0
            for n, k in sorted(bin_.items(), reverse=True):
                rows.setdefault(n, []).append((used.get(n, 0), sequence, offset, k))
                used[n] = used.get(n, 0) + k * times
                offset += n * k
            sequence += times
        self._of = {n: np.array(x, dtype=np.int64) for n, x in rows.items()}
        self.sequences = sequence

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for n in np.unique(length).tolist():
            at, table = np.flatnonzero(length == n), self._of[n]
            row = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
            within = rank[at] - row[:, 0]
            sequence[at] = row[:, 1] + within // row[:, 3]
            offset[at] = row[:, 2] + within % row[:, 3] * n
        return sequence, offset


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, folder: str | None = None, capacity: int = CAPACITY, text: str = "text",
    key: str = "doc_id") -> DataFrame:
    """Each document's ids and END in pieces of `capacity`, of which only the first may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.uint32(END).tobytes()
        for batch in batches:
            for part in slices(batch, "t", 1 << 22):
                rows: list[tuple] = []
                for k, ids in zip(part.column("k").to_pylist(), encoder(vocabulary, folder).encode(part.column("t").to_pylist()), strict=True):
                    ids += tail
                    n, at = len(ids) // 4, 0
                    size = n % capacity or capacity
                    while at < n:
                        rows.append((k, len(rows) and at and rows[-1][1] + 1, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                        at, size = at + size, capacity
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    bounded(docs.sparkSession)
    return docs.select(column(key).cast("long").alias("k"), column(text).alias("t")).mapInArrow(run, _PIECES)


def pack(docs: DataFrame, capacity: int = CAPACITY, **names) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset, a row a piece.

    A null or empty text is END alone. Rows repeated with the same key are documents of their own, and null keys stay
    null. Other columns are not read. An empty table gives no rows. Ties of length are broken by key, piece and
    checksum; pieces equal in all of them are interchangeable. The pieces, without their ids, are written to the shared
    folder once; ranks are dealt in parts of bounded size, so no task holds all pieces of a length, nor all of a third of the
    rows that are equal. At most `capacity` lengths and some hundred thousand parts' sizes are broadcast: a few MB.
    """
    pieces = materialize(token_pieces(docs, capacity=capacity, **names).withColumn("salt", F.spark_partition_id()), "pieces")
    histogram = {int(r.length): int(r.n) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    deal = Deal(plan(histogram, capacity))
    each = max(RANKED, sum(histogram.values()) // 100_000)
    spark = docs.sparkSession
    parts = spark.createDataFrame([(n, -(-c // each)) for n, c in histogram.items()], "length long, parts long")
    rows = pieces.join(F.broadcast(parts), "length")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", "salt"), F.col("parts"))).drop("parts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).select("length", "part",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = rows.withColumn("inside", inside).join(F.broadcast(sizes), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("before") + F.col("inside")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = deal(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, _PIECES + ", sequence_id long, offset long")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
