"""What the corpus operators share: the shared folder, Arrow text as numpy bytes, word boundaries and hashes."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a temporary one, which serves one machine alone: on a
    cluster, whose executors would not see it, that is an error."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return "file://" + _own_dir


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: a cut of the lineage that outlives lost executors.
    `release` deletes it; what a returned DataFrame still reads stays until the folder's owner clears it."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes the files of a materialized DataFrame that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def row_id(text: str, key: str) -> Column:
    """What rows are told apart by: a hash of key and text."""
    return F.xxhash64(column(key).cast("long"), column(text))


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches from Spark's default of 64 MB to 8 MB: each batch is held by the JVM and by a
    Python worker at once, for each task. A setting of the session's own stays."""
    if spark.conf.get(_BATCH) in ("67108864b", "67108864", "64MB", "64m"):
        spark.conf.set(_BATCH, "8m")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


def column(name: str) -> Column:
    """A column by its exact name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


@cache
def _malloc_trim() -> Callable[[int], int] | None:
    """glibc's; other C libraries have none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def trimmed(run: Callable) -> Callable:
    """run for mapInArrow, after which the worker gives back the memory that it no longer uses: Spark keeps its Python
    workers for later tasks, of other stages too, and what arrays and batches took would stay with them."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := _malloc_trim():
                trim(0)

    return whole


def map_rows(df: DataFrame, run: Callable, names: list[str]) -> DataFrame:
    """mapInArrow over columns of any names, which Spark's own takes without dots only: inside, columns have places, and
    `run` gives back those called `names`, with their types."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    kept = [plain.schema[f"c{df.columns.index(n)}"] for n in names]
    return plain.mapInArrow(trimmed(run), StructType(kept)).toDF(*names)


#: Rows that a broadcast may have, of two longs at most: some 32 MB. Larger tables are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """df, a written table, with the hint to broadcast it where a count shows that it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: The bytes x20 and x09 to x0D part words; all others belong to words.
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False

#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    #: A 64-bit value for each byte, so that hashes don't depend on the bytes' small numbers.
    BYTE_VALUE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64; kept and enlarged for the process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = np.ones(size, dtype=np.uint64)
        done = 1
        while done < size:
            step = np.uint64(pow(base, done, 1 << 64))
            out[done : 2 * done] = out[:done] * step
            done *= 2
        _powers[base] = have = out
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one after the other, and n+1 offsets. Null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Parts of the batch with about `limit` bytes of text each, a longer text alone in its own: bounds numpy's memory."""
    n = len(batch)
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    first, total = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > first and total + s > limit:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += s
    yield batch.slice(first)


def word_bounds(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all runs of word bytes; none crosses a text's end."""
    w = in_word[data]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    before = np.zeros(len(w), dtype=bool)
    before[1:] = w[:-1]
    before[edge] = False
    starts = np.flatnonzero(w & ~before)
    after = np.zeros(len(w), dtype=bool)
    after[:-1] = w[1:]
    after[edge - 1] = False
    return starts, np.flatnonzero(w & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes in each span: a polynomial over random byte values, mixed. Equal bytes, equal hashes;
    different ones collide with a chance of about 2**-64 a pair."""
    n = len(data)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUE[data] * _power_table(_BASE, n), out=total[1:])
        h = (total[ends] - total[starts]) * _power_table(_BASE_INVERSE, n + 1)[starts]
        return _mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def counts_between(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the sorted positions lie in each text."""
    return np.diff(np.searchsorted(positions, offsets))
