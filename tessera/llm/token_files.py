"""Token ids in binary files: each document a zstandard frame of its own, with a dictionary shared by all.

A file (a value of the `file` column; Spark's writer puts the files into the shared folder) is

    magic "TSRA" 0x01 | 16 bytes of the dictionary's SHA-256 | uint32 documents n
    int64 doc_id * n | uint8 doc_id is null * n | uint64 first id * (n + 1) | uint64 frame offset * (n + 1) | frames

all little-endian; a frame holds uint32 ids. Both indexes are relative to the file, so one document is read without the
others.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, documents, shared_dir, slices
from .vocab import encoder

VOCABULARY, END = "word_bpe_49k.json", 2
MAGIC = b"TSRA\x01"
#: Bytes of frames in a file at least, but for the last of a partition.
FILE_BYTES = 4 << 20
#: The dictionary is trained on so many documents, those with the smallest hashes of their keys: of each, a slice of at
#: most so many ids of its whole id array, from a place that the key's hash names. It changes the files' size, never what
#: is read from them.
SAMPLE, SAMPLE_IDS, DICTIONARY_BYTES = 1000, 4096, 64 << 10
LEVEL = 1


class TokenFile:
    """Reads single documents of a file."""

    def __init__(self, file: bytes, dictionary: bytes):
        n = struct.unpack_from("<I", file, len(MAGIC) + 16)[0]
        if file[: len(MAGIC)] != MAGIC or file[len(MAGIC) : len(MAGIC) + 16] != dictionary_hash(dictionary):
            raise ValueError("not a token file, or one of another dictionary")
        at = len(MAGIC) + 20
        self.keys = np.frombuffer(file, "<i8", n, at)
        self.null = np.frombuffer(file, np.uint8, n, at + 8 * n).astype(bool)
        at += 9 * n
        self.first = np.frombuffer(file, "<u8", n + 1, at)
        self._frame = np.frombuffer(file, "<u8", n + 1, at + 8 * (n + 1))
        self._body, self._file = at + 16 * (n + 1), file
        self._reader = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.keys)

    def ids(self, i: int) -> bytes:
        a, b = self._body + int(self._frame[i]), self._body + int(self._frame[i + 1])
        return self._reader.decompress(self._file[a:b])


def dictionary_hash(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()[:16]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw)


def train(samples: list[bytes]) -> bytes:
    """A trained dictionary; of too few samples for training, their plain bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"\0" * 8 + b"".join(samples))[-DICTIONARY_BYTES:]


def pack_file(dictionary: bytes, keys: list[int | None], counts: list[int], frames: list[bytes]) -> bytes:
    ends = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)]).astype("<u8").tobytes()
    head = MAGIC + dictionary_hash(dictionary) + struct.pack("<I", len(keys))
    ids = np.array([k or 0 for k in keys], "<i8").tobytes() + np.array([k is None for k in keys], np.uint8).tobytes()
    return head + ids + ends(counts) + ends([len(f) for f in frames]) + b"".join(frames)


def _samples(rows: DataFrame, vocabulary: str, folder: str | None) -> list[bytes]:
    """Slices of the id arrays of SAMPLE documents: a row for each chosen key, however many rows it has."""
    keys = rows.select("k").distinct().orderBy(F.xxhash64("k")).limit(SAMPLE)
    chosen = rows.join(F.broadcast(keys), "k", "left_semi").dropDuplicates(["k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, "t", 1 << 22):
                out = []
                for h, ids in zip(s.column("h").to_pylist(), encoder(vocabulary, folder).encode(s.column("t").to_pylist()), strict=True):
                    ids += np.uint32(END).tobytes()
                    first = h % max(1, len(ids) // 4 - SAMPLE_IDS + 1)
                    out.append(ids[4 * first : 4 * (first + SAMPLE_IDS)])
                yield pa.RecordBatch.from_arrays([s.column("h"), pa.array(out, pa.binary())], names=["h", "ids"])

    taken = chosen.select(F.xxhash64("k").alias("h"), "t").mapInArrow(run, "h long, ids binary")
    return [bytes(r.ids) for r in taken.orderBy("h").collect()]


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, folder: str | None = None, text: str = "text", key: str = "doc_id") -> None:
    """Writes path/files (part, number, before, documents, ids, file) and path/dictionary (dictionary), in ascending order
    of key: parts in the order of their numbers, and in each its files in the order of theirs; `before` counts the ids of
    the part's earlier files.

    A null or empty text is END alone. Null keys come first. Rows repeated with one key are documents of their own and
    follow each other. Other columns are not read. An empty table gives an empty folder of files.
    """
    spark = docs.sparkSession
    bounded(spark)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    tail = np.uint32(END).tobytes()
    dictionary = train(_samples(rows, vocabulary, folder))
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").write.parquet(f"{path}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        part, number, before = TaskContext.get().partitionId(), 0, 0
        keys, counts, frames, size = [], [], [], 0

        def file() -> pa.RecordBatch:
            row = {"part": part, "number": number, "before": before, "documents": len(keys), "ids": sum(counts),
                "file": pack_file(dictionary, keys, counts, frames)}
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in batches:
            for s in slices(batch, "t", 1 << 22):
                for k, ids in zip(s.column("k").to_pylist(), encoder(vocabulary, folder).encode(s.column("t").to_pylist()), strict=True):
                    ids += tail
                    keys.append(k)
                    counts.append(len(ids) // 4)
                    frames.append(squeeze.compress(ids))
                    size += len(frames[-1])
                    if size >= FILE_BYTES:
                        yield file()
                        number, before = number + 1, before + sum(counts)
                        keys, counts, frames, size = [], [], [], 0
        if keys:
            yield file()

    ordered = rows.repartitionByRange(F.col("k"), F.xxhash64("t")).sortWithinPartitions("k")
    files = ordered.mapInArrow(run, "part int, number int, before long, documents long, ids long, file binary")
    files.write.option("compression", "none").parquet(f"{path}/files")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the files of write(). Counts of ids are summed up over
    parts, by a window over a row a part, and joined by a broadcast of 12 bytes a part: parts are the tasks of the writing
    job, so even a million of them make 12 MB. Within parts and files the sums are in the files."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary)
    files = spark.read.parquet(f"{path}/files")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, file in zip(batch.column("base").to_pylist(), batch.column("file"), strict=True):
                f = TokenFile(file.as_py(), dictionary)
                keys = pa.array(f.keys, pa.int64(), mask=f.null)
                crc = pa.array([zlib.crc32(f.ids(i)) for i in range(len(f))], pa.int64())
                first = f.first.astype(np.int64)
                yield pa.RecordBatch.from_arrays([keys, pa.array(first[:-1] + base), pa.array(np.diff(first)), crc],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = files.select("part", "before", "file").join(F.broadcast(parts), "part").select((F.col("first") + F.col("before")).alias("base"), "file")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, from the files. A null or empty text is END alone; null keys come first; rows repeated with one
    key follow each other, in no fixed order where their texts differ. An empty table gives no rows."""
    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write(documents(spark, sf_dir), path)
    return read(spark, path)
