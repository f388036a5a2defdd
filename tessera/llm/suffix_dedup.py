"""Suffix-array dedup: removes every byte that a string of `WINDOW` bytes covers which also starts elsewhere.

A suffix array over a whole corpus would move every suffix. Here the strings are dealt first, so that equal ones meet:
each string of WINDOW bytes has an anchor, the GRAM-byte part with the smallest hash in it (the first of equal ones),
which depends on the string's bytes alone. Consecutive strings with one anchor form a slice. Anchors that occur once
in the corpus end here; slices with equal bytes form a class, and of a class only one slice goes on: if the class has
several, all their strings repeat. Where an anchor has several classes, their slices meet in one block, whose suffix
array tells which strings they share:

two-stage sorting sorts directly only the suffixes smaller than their successors; scanning the buckets of first bytes
from the smallest up, each suffix read puts its predecessor, if that is larger, into the next place of its bucket.
Adjacent common prefixes of WINDOW bytes or more are repeats. Blocks hold whole anchors and are bounded by
BLOCK_BYTES or the slices of one anchor. Slices of anchors with more than HOT classes are cut on into chunks of CHUNK
strings and dealt by what their strings share (see `_recut`); groups of chunks then meet in suffix arrays as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BASE, _BASE_INVERSE, BROADCAST_ROWS, BYTE_VALUE, _mix, _power_table, bounded, column, documents, fresh, map_rows, materialize, row_id, slices, small, text_bytes, trimmed

WINDOW, GRAM = 200, 32
#: Bytes of slices that are sorted together; the arrays of a block take some hundred times as much.
BLOCK_BYTES = 1 << 19
#: Classes of an anchor, or of a group of chunks, above which it is cut on.
HOT, CHUNK = 256, 32
#: A text is searched for anchors in parts of so many string starts, each with the bytes its last strings need.
PART = 1 << 19


def _eights(data: np.ndarray, big: bool) -> np.ndarray:
    """The eight bytes from each position as an integer; zeros beyond the end. big: in the order of the bytes."""
    out = np.zeros(len(data) + 8, np.uint64)
    out[: len(data)] = data
    for n in (1, 2, 4):
        step = np.zeros_like(out)
        step[:-n] = out[n:]
        out = (out << np.uint64(8 * n)) | step if big else out | (step << np.uint64(8 * n))
    return out


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """The slices of the texts in data: anchor hash, text, first string start and number of strings (in data), and the
    anchor's distance from the first string's start."""
    n, span = len(data), WINDOW - GRAM + 1
    if n < WINDOW:
        return (np.zeros(0, np.int64),) * 5
    with np.errstate(over="ignore"):
        h = _mix(_eights(data, False)[:n])
        for step, by in ((8, 0x9E3779B97F4A7C15), (16, 0xC2B2AE3D27D4EB4F)):
            nxt = np.zeros_like(h)
            nxt[:-step] = h[step:]
            h = h * np.uint64(by) + nxt
        h = _mix(h)
    bits = np.uint64(max(1, int(n).bit_length()))
    low = (h >> bits << bits) | np.arange(n, dtype=np.uint64)  # equal hashes: the first position
    width = 1
    while 2 * width <= span:
        low[:-width] = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low[: -(span - width)] = np.minimum(low[: -(span - width)], low[span - width :])
    count = np.maximum(np.diff(offsets) - WINDOW + 1, 0)  # strings of each text
    text = np.repeat(np.arange(len(count)), count)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    start = offsets[:-1][text] + np.arange(count.sum()) - first[text]
    at = (low[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    run = np.flatnonzero(new)
    return h[at[run]].view(np.int64), text[run], start[run], np.diff(np.append(run, len(at))), at[run] - start[run]


def _direct(pos: np.ndarray, eights: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The positions sorted by their first WINDOW bytes. Groups of equal ones skip what all their members share, which
    hashes of 128 to 8 bytes tell, and are then parted by the next eight bytes."""
    end, inverse = len(hashes) - 1, _power_table(_BASE_INVERSE, len(hashes))
    order = np.argsort(eights[pos], kind="stable")
    pos = pos[order]
    key = eights[pos]
    at = np.arange(len(pos))  # places in pos still to be parted, by group
    new = np.ones(len(pos), bool)
    new[1:] = key[1:] != key[:-1]
    depth = np.full(len(pos), 8)
    while len(at):
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(at)))
        open_ = np.repeat((sizes > 1) & (depth[first] < WINDOW), sizes)
        at, new, depth = at[open_], new[open_], depth[open_]
        if not len(at):
            break
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(at)))
        group = np.repeat(np.arange(len(first)), sizes)
        p = pos[at]
        for skip in (128, 64, 32, 16, 8):
            a = np.minimum(p + depth, end)
            b = np.minimum(a + skip, end)
            with np.errstate(over="ignore"):
                h = (hashes[b] - hashes[a]) * inverse[a]
            same = np.logical_and.reduceat((h == h[first][group]) & (p + depth + skip <= end), first)
            depth = depth + skip * same[group]
        key = eights[np.minimum(p + depth, end)]
        order = np.lexsort((key, group))
        pos[at] = p[order]
        key = key[order]
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        depth = depth + 8
    return pos


def _needed(wanted: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """The wanted positions, and those after each run of them up to the first that is sorted directly: its predecessors'
    places follow from its own."""
    n = len(wanted)
    last = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
    last = last[~smaller[last]]
    direct = np.append(np.flatnonzero(smaller), n - 1)
    stop = np.minimum(direct[np.searchsorted(direct[:-1], last)], n - 1)
    edges = np.zeros(n + 2, np.int64)
    np.add.at(edges, last + 1, 1)
    np.add.at(edges, stop + 1, -1)
    return wanted | (np.cumsum(edges)[:n] > 0)


def suffix_array(data: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """The wanted positions (all, by default) and those that place them, sorted by their first WINDOW bytes at least (equal
    ones in any order); the end is smaller than any byte."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    eights = _eights(data, True)
    with np.errstate(over="ignore"):
        hashes = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * _power_table(_BASE, n), out=hashes[1:])
    # smaller than the successor: decided by the first byte that differs from the next one; the last suffix is larger
    turn = np.flatnonzero(data[1:] != data[:-1])
    rises = np.zeros(len(turn) + 1, bool)
    rises[:-1] = data[turn] < data[turn + 1]
    smaller = rises[np.searchsorted(turn, np.arange(n))]
    needed = np.ones(n, bool) if wanted is None else _needed(wanted, smaller)
    direct = _direct(np.flatnonzero(smaller & needed), eights[: n + 1], hashes)
    bounds = np.searchsorted(data[direct], np.arange(257))  # direct suffixes are in the order of their first bytes
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    if needed[n - 1]:
        larger[data[n - 1]].append(np.array([n - 1]))  # the predecessor of the end
    out = []
    for c in range(256):
        done: list[np.ndarray] = []
        todo = larger[c]
        while todo:  # predecessors with the same first byte come into this bucket while it is read
            now = np.concatenate(todo) if len(todo) > 1 else todo[0]
            done.append(now)
            before = now[now > 0] - 1
            before = before[(data[before] == c) & needed[before]]
            todo = [before] if len(before) else []
        done.append(direct[bounds[c] : bounds[c + 1]])
        bucket = np.concatenate(done)
        larger[c] = []
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(data[before] > c) & needed[before]]
        if len(before):
            byte = data[before]
            order = np.argsort(byte, kind="stable")
            before, byte = before[order], byte[order]
            cut = np.flatnonzero(byte[1:] != byte[:-1]) + 1
            for part in np.split(before, cut):
                larger[data[part[0]]].append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def adjacent_prefixes(order: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, up to WINDOW bytes; 0 for the first."""
    eights = _eights(data, True)
    end = len(data)
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    while len(live):
        a, b = order[live] + out[live], order[live - 1] + out[live]
        inside = (a < end) & (b < end)
        differ = eights[np.minimum(a, end)] ^ eights[np.minimum(b, end)]
        same = np.full(len(live), 8)
        odd = np.flatnonzero(differ)
        # float64 keeps the highest bit's place but may round up to the next power, where the byte's edge needs care
        top = np.frexp((differ[odd] >> np.uint64(32)).astype(np.float64))[1]
        bottom = np.frexp((differ[odd] & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
        same[odd] = np.where(top > 0, (32 - top) // 8, 4 + (32 - bottom) // 8)
        same = np.minimum(np.where(inside, same, 0), np.maximum(end - np.maximum(a, b), 0))
        out[live] += same
        live = live[(same == 8) & (out[live] < WINDOW)]
    return np.minimum(out, WINDOW)


def repeats(parts: list[bytes]) -> list[np.ndarray]:
    """For each slice, which of its strings of WINDOW bytes occur at another place in the block."""
    lengths = np.array([len(p) for p in parts])
    first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    data = np.frombuffer(b"\0".join(parts), np.uint8)
    valid = np.zeros(len(data) + 1, bool)
    strings = np.maximum(lengths - WINDOW + 1, 0)
    flat = np.repeat(first - np.concatenate([[0], np.cumsum(strings)[:-1]]), strings) + np.arange(strings.sum())
    valid[flat] = True
    order = suffix_array(data, valid[: len(data)])
    order = order[valid[order]]
    lcp = adjacent_prefixes(order, data)
    hit = lcp >= WINDOW
    hit[:-1] |= hit[1:]
    marked = np.zeros(len(data) + 1, bool)
    marked[order[hit]] = True
    return [marked[a : a + s] for a, s in zip(first.tolist(), strings.tolist(), strict=True)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _find(rows: DataFrame) -> DataFrame:
    """h, s (hash of the slice's bytes), row, start, strings and shift of all slices of rows (row, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", 1 << 19):
                data, offsets = text_bytes(part.column("t"))
                row = part.column("row").to_numpy()
                for lo in range(0, max(len(data), 1), PART) if len(part) == 1 else (None,):
                    if lo is None:
                        d, o, base = data, offsets, 0
                    else:  # strings that start in this part; slices end at its end, in each text at the same places
                        d, base = data[lo : lo + PART + WINDOW - 1], lo
                        o = np.array([0, len(d)])
                    h, text, start, strings, shift = anchors(d, o)
                    if not len(h):
                        continue
                    raw = d.tobytes()
                    ends = start + strings + WINDOW - 1
                    s = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), ends.tolist(), strict=True)], np.uint64)
                    columns = [pa.array(h), pa.array(s.view(np.int64)), pa.array(row[text]), pa.array(start - o[:-1][text] + base),
                        pa.array(strings, pa.int32()), pa.array(shift, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["h", "s", "row", "start", "strings", "shift"])

    return rows.mapInArrow(trimmed(run), "h long, s long, row long, start long, strings int, shift int")


def _cut(asked: DataFrame) -> DataFrame:
    """The slices asked for, from rows (row, t, wants [(h, start, shift, strings, hot)])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row, t, wants in zip(batch.column("row").to_pylist(), batch.column("t"), batch.column("wants").to_pylist(), strict=True):
                raw = t.as_py().encode()
                for w in wants:
                    size += w["strings"] + WINDOW - 1
                    out.append((w["h"], row, w["start"], w["shift"], w["hot"], raw[w["start"] : w["start"] + w["strings"] + WINDOW - 1]))
                    if size > 1 << 22:
                        yield _slice_batch(out)
                        out, size = [], 0
            if out:
                yield _slice_batch(out)

    return asked.mapInArrow(trimmed(run), "h long, row long, start long, shift int, hot boolean, b binary")


def _slice_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"h": pa.int64(), "row": pa.int64(), "start": pa.int64(), "shift": pa.int32(), "hot": pa.bool_(), "b": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def _sort(cut: DataFrame) -> DataFrame:
    """row, start, strings of the repeated strings, from slices dealt and sorted by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size, last = 0, None

        def done() -> Iterator[pa.RecordBatch]:
            rows = [(row, start + a, b - a) for (row, start, _), m in zip(held, repeats([x[2] for x in held]), strict=True) for a, b in _runs(m)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["row", "start", "strings"])

        for batch in batches:
            for h, row, start, b in zip(*(batch.column(c).to_pylist() for c in ("h", "row", "start", "b")), strict=True):
                if h != last and size >= BLOCK_BYTES:
                    yield from done()
                    held, size = [], 0
                held.append((row, start, b))
                size, last = size + len(b), h
        if held:
            yield from done()

    return cut.mapInArrow(trimmed(run), "row long, start long, strings long")


def _windows(cut: DataFrame) -> DataFrame:
    """h2, row, start of each single string of the slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, start, b in zip(*(batch.column(c).to_pylist() for c in ("row", "start", "b")), strict=True):
                at = range(len(b) - WINDOW + 1)
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(b[i : i + WINDOW]) for i in at], pa.binary()),
                    pa.array([row] * len(at), pa.int64()), pa.array([start + i for i in at], pa.int64())], names=["h2", "row", "start"])

    return cut.mapInArrow(trimmed(run), "h2 binary, row long, start long")


def _recut(cut: DataFrame, width: int) -> DataFrame:
    """Slices cut on: strings whose anchor lies `width` * j to `width` * (j + 1) - 1 bytes after their start form chunk j.
    g is a hash of the anchor, j and the bytes that all strings of a whole chunk share, so equal strings have equal g; s
    is a hash of the chunk's bytes b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            out = []
            for h, row, start, shift, b in zip(*(batch.column(c).to_pylist() for c in ("h", "row", "start", "shift", "b")), strict=True):
                least = shift - (len(b) - WINDOW)  # the last string's distance to its anchor
                for j in range(least // width, shift // width + 1):
                    far, near = min(shift, (j + 1) * width - 1), max(least, j * width)
                    part = b[shift - far : shift - near + WINDOW]
                    shared = b[shift - j * width : shift - (j + 1) * width + 1 + WINDOW]
                    g = xxhash.xxh3_128_digest(shared, seed=(h ^ j) & (2**64 - 1))
                    out.append((g, xxhash.xxh3_128_digest(part), row, start + shift - far, far - near + 1, part))
                if len(out) > 1 << 14:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                        names=["g", "s", "row", "start", "strings", "b"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                    names=["g", "s", "row", "start", "strings", "b"])

    return cut.mapInArrow(trimmed(run), "g binary, s binary, row long, start long, strings long, b binary")


def _hot_marks(cut: DataFrame, hot: int) -> DataFrame:
    """row, start, strings of the repeated strings of hot anchors. Equal chunks form classes, of which one goes on; groups
    of several classes meet in suffix arrays. What only the edges of CHUNK strings tell apart and still has more than
    `hot` classes is dealt by single strings, which are equal or apart."""
    chunks = materialize(_recut(cut, CHUNK), "suffix-chunks")
    classes = chunks.groupBy("g", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "start", "strings", "b")).alias("one"))
    classes = materialize(classes.select("g", "s", "n", "one.*"), "suffix-chunk-classes")
    equal = chunks.join(classes.where("n > 1").select("g", "s"), ["g", "s"], "left_semi").select("row", "start", "strings")
    mixed = materialize(classes.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "suffix-chunk-groups")
    few = classes.join(mixed.where(F.col("c") <= hot).select("g"), "g", "left_semi").select(F.col("g").alias("h"), "row", "start", "b")
    marks = equal.unionByName(_sort(few.repartition("h").sortWithinPartitions("h")))
    if mixed.where(F.col("c") > hot).limit(1).count():
        single = _windows(classes.join(mixed.where(F.col("c") > hot).select("g"), "g", "left_semi").select("row", "start", "b"))
        single = materialize(single, "suffix-strings")
        again = materialize(single.groupBy("h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h2"), "suffix-strings-again")
        marks = marks.unionByName(single.join(again, "h2", "left_semi").select("row", "start", F.lit(1).cast("long").alias("strings")))
    return marks


def repeated_strings(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """row, start, strings: the runs of repeated strings in rows (row, k, t)."""
    found = materialize(_find(rows.select("row", "t")), "suffix-found")
    # written, so that the join deals both its sides and can split an anchor that holds many rows
    several = materialize(found.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"), "suffix-anchors")
    slices_ = materialize(found.join(several, "h", "left_semi"), "suffix-slices")
    classes = slices_.groupBy("h", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "start", "shift", "strings")).alias("one"))
    classes = materialize(classes.select("h", "s", "n", "one.*"), "suffix-classes")
    equal = slices_.join(classes.where("n > 1").select("h", "s"), ["h", "s"], "left_semi").select("row", "start",
        F.col("strings").cast("long").alias("strings"))
    mixed = materialize(classes.groupBy("h").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1"), "suffix-mixed")
    wants = classes.join(mixed, "h").select("row", F.struct("h", "start", "shift", "strings", (F.col("classes") > hot).alias("hot")).alias("w"))
    wants = materialize(wants.groupBy("row").agg(F.collect_list("w").alias("wants")), "suffix-wants")
    asked = rows.select("row", "t").join(small(wants.select("row")), "row", "left_semi").dropDuplicates(["row"]).join(wants, "row")
    cut = materialize(_cut(asked.select("row", "t", "wants")), "suffix-cut")
    marks = _sort(cut.where("NOT hot").select("h", "row", "start", "b").repartition("h").sortWithinPartitions("h"))
    out = equal.unionByName(materialize(marks, "suffix-marks"))
    if mixed.where(F.col("classes") > hot).limit(1).count():
        out = out.unionByName(materialize(_hot_marks(cut.where("hot"), hot), "suffix-hot-marks"))
    return out


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _with_marks(docs: DataFrame, rows: DataFrame, row: str, marks: str, hot: int) -> DataFrame:
    """docs, with a column `row` that names its rows as in rows (row, k, t), and `marks`: the repeated strings of each as
    (start, strings), null without any. Texts without marks stay where they are while the others' names are few enough to
    be broadcast; else all meet their marks in a shuffle."""
    found = repeated_strings(rows, hot).groupBy("row").agg(F.collect_set(F.struct("start", "strings")).alias(marks))
    found = materialize(found.withColumnRenamed("row", row), "suffix-found-marks")
    if found.count() > BROADCAST_ROWS:
        return docs.join(found, row, "left")
    ids = F.broadcast(found.select(row))
    none = F.lit(None).cast(found.schema[marks].dataType).alias(marks)
    touched = docs.join(ids, row, "left_semi").join(found, row)
    return touched.unionByName(docs.join(ids, row, "left_anti").select(*map(column, docs.columns), none))


def _removed(marks: list | None) -> list[list[int]]:
    """The maximal runs of bytes that the strings cover."""
    runs: list[list[int]] = []
    for a, b in sorted((x["start"], x["start"] + x["strings"] + WINDOW - 1) for x in marks or ()):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return runs


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", hot: int = HOT) -> DataFrame:
    """A row for each row of docs: bytes, removed bytes, maximal removed runs, SHA-256 of the bytes left.

    Strings are judged on the input, overlaps and the same text included. A null text counts as empty; texts under
    WINDOW bytes lose nothing; repeated rows are rows of their own, so both lose all of a text of WINDOW bytes or more;
    null keys stay null. Other columns are not read. An empty table gives no rows.
    """
    bounded(docs.sparkSession)
    rows = docs.select(column(key).cast("long").alias("k"), column(text).alias("t"), row_id(text, key).alias("row"))
    joined = _with_marks(rows, rows, "row", "marks", hot).select("k", "t", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, t, m in zip(batch.column("k").to_pylist(), batch.column("t"), batch.column("marks").to_pylist(), strict=True):
                raw, runs = (t.as_py() or "").encode(), _removed(m)
                left = _without(raw, runs)
                out.append((k, len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(trimmed(run), _RESULT)


def remove(docs: DataFrame, text: str = "text", key: str = "doc_id", hot: int = HOT) -> DataFrame:
    """docs, each text without its repeated strings; every row and column stays, whatever the columns' names. A removed
    run gives back the bytes of characters that it cuts. Null texts stay null; the rest is as in dedup()."""
    rows = docs.select(column(key).cast("long").alias("k"), column(text).alias("t"), row_id(text, key).alias("row"))
    row, marks = fresh(docs, "row"), fresh(docs, "marks")
    bounded(docs.sparkSession)
    joined = _with_marks(docs.withColumn(row, row_id(text, key)), rows, row, marks, hot).select(*map(column, docs.columns), marks)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, m in enumerate(batch.column(len(batch.columns) - 1).to_pylist()):
                if m:
                    raw = texts[i].encode()
                    texts[i] = _without(raw, [_whole(raw, *r) for r in _removed(m)]).decode()
            columns = [pa.array(texts, c.type) if j == at else c for j, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return map_rows(joined, run, docs.columns)


def _without(raw: bytes, runs: list) -> bytes:
    out, done = [], 0
    for a, b in runs:
        out.append(raw[done:a])
        done = max(done, b)
    return b"".join([*out, raw[done:]])


def _whole(raw: bytes, a: int, b: int) -> tuple[int, int]:
    """The run without the bytes of characters that lie partly outside."""
    while a < b and raw[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))
