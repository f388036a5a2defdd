"""Bytes out of rasters and back: frequency tables, sections of entropy-coded symbols, planes and blocks.

A section holds the symbols of one plane (or of one plane's blocks in one pass), so there are as many tasks as planes, and
each is coded and read on its own. The layout is this library's: a count, the contexts' tables, the coded tokens, and the
bits that large symbols have besides their token.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .entropy import LOW, SLOTS, BITS, matches, normalise_counts, rans_encode, unmatch, varint

PLANE = ["image_id", "c"]
#: Of seven bits each, in a long from 0 on.
GROUPS = 9


class Reader:
    """Reads a section from its start."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("beyond the end")
        self.at += n
        return self.data[self.at - n : self.at]

    def varint(self) -> int:
        n, shift = 0, 0
        while True:
            byte = self.take(1)[0]
            n |= (byte & 127) << shift
            if byte < 128:
                return n
            shift += 7


def write_table(freq: list[int], runs: bool | None = None) -> bytes:
    """A frequency table as two bytes a symbol, or as runs of equal frequencies; None: what is shorter."""
    raw = b"\0" + varint(len(freq)) + b"".join(int(f).to_bytes(2, "big") for f in freq)
    at = [0, *(i for i in range(1, len(freq)) if freq[i] != freq[i - 1]), len(freq)] if freq else [0]
    packed = b"\1" + varint(len(at) - 1) + b"".join(varint(b - a) + varint(int(freq[a])) for a, b in zip(at, at[1:], strict=False))
    return packed if runs or (runs is None and len(packed) < len(raw)) else raw


def read_table(reader: Reader) -> list[int]:
    kind, n = reader.take(1)[0], reader.varint()
    if kind == 0:
        return list(struct.unpack(f">{n}H", reader.take(2 * n)))
    return [f for _ in range(n) for length, f in [(reader.varint(), reader.varint())] for _ in range(length)]


def _tokens(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sixteen direct tokens, then one for each length in bits; and how many bits follow."""
    size = np.frexp(symbols.astype(np.float64))[1]
    return np.where(symbols < 16, symbols, size + 11), np.where(symbols < 16, 0, size - 1)


def write_section(symbols: np.ndarray, contexts: np.ndarray) -> bytes:
    """Symbols from 0 to 2**32, each with its context."""
    symbols = np.asarray(symbols, np.int64)
    tokens, more = _tokens(symbols)
    tables, head = {}, [varint(len(symbols))]
    kinds = np.unique(contexts).tolist() if len(symbols) else []
    head.append(varint(len(kinds)))
    for c in kinds:
        tables[c] = normalise_counts(np.bincount(tokens[contexts == c]))
        head += [varint(c), write_table(tables[c][0].tolist())]
    coded = rans_encode(tokens.tolist(), np.asarray(contexts).tolist(), tables)
    bits = "".join(f"{s & ((1 << n) - 1):0{n}b}" for s, n in zip(symbols[more > 0].tolist(), more[more > 0].tolist(), strict=True))
    tail = int("1" + bits, 2).to_bytes(len(bits) // 8 + 1, "big")
    return b"".join([*head, varint(len(coded)), coded, varint(len(tail)), tail])


def read_section(data: bytes, context: Callable[[int, list[int]], int]) -> list[int]:
    """The symbols; context(i, symbols before) tells the i-th one's context."""
    reader = Reader(data)
    n, tables = reader.varint(), {}
    for _ in range(reader.varint()):
        c, freq = reader.varint(), read_table(reader)
        lookup = np.repeat(np.arange(len(freq)), freq).tolist()
        tables[c] = freq, np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(int).tolist(), lookup
    coded = reader.take(reader.varint())
    tail = reader.take(reader.varint())
    bits = bin(int.from_bytes(tail, "big"))[3:]
    state, at, bit, out = int.from_bytes(coded[:4], "big"), 4, 0, []
    for i in range(n):
        freq, cum, lookup = tables[context(i, out)]
        slot = state & (SLOTS - 1)
        s = lookup[slot]
        state = freq[s] * (state >> BITS) + slot - cum[s]
        while state < LOW and at < len(coded):
            state, at = (state << 8) | coded[at], at + 1
        if s >= 16:
            more = s - 12
            s, bit = (1 << more) | int(bits[bit : bit + more], 2), bit + more
        out.append(s)
    return out


def fold(v: np.ndarray) -> np.ndarray:
    return np.where(v >= 0, 2 * v, -2 * v - 1)


def unfold(u: np.ndarray) -> np.ndarray:
    return np.where(u % 2 == 0, u // 2, -(u + 1) // 2)


def _context(n: int, w: int, nw: int) -> int:
    mean = (n + w + nw) // 3
    return 2 * (0 if mean == 0 else 1 if mean < 16 else 2 if mean < 256 else 3) + (n > w)


def write_plane(r: np.ndarray) -> bytes:
    """Residuals in raster order; contexts by the sizes of the three decided ones around."""
    a = np.pad(np.abs(r), ((1, 0), (1, 0)))
    n, w, nw = a[:-1, 1:], a[1:, :-1], a[:-1, :-1]
    mean = (n + w + nw) // 3
    contexts = 2 * np.select([mean == 0, mean < 16, mean < 256], [0, 1, 2], 3) + (n > w)
    return write_section(fold(r).ravel(), contexts.ravel())


def read_plane(data: bytes, width: int, height: int) -> np.ndarray:
    size: list[int] = []  # of the residuals so far

    def context(i: int, out: list[int]) -> int:
        if i:
            size.append((out[-1] + 1) // 2)
        y, x = divmod(i, width)
        return _context(size[i - width] if y else 0, size[i - 1] if x else 0, size[i - width - 1] if x and y else 0)

    return unfold(np.array(read_section(data, context), np.int64)).reshape(height, width)


def plane_sections(residuals: DataFrame, width: int, height: int, value: str = "r") -> DataFrame:
    """image_id, c and data: one section for each plane of residuals."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        plane = np.zeros((height, width), np.int64)
        plane[frame["y"], frame["x"]] = frame[value]
        return pd.DataFrame({"image_id": [frame["image_id"].iloc[0]], "c": [frame["c"].iloc[0]], "data": [write_plane(plane)]})

    return residuals.select(*PLANE, "y", "x", value).groupBy(*PLANE).applyInPandas(run, "image_id long, c long, data binary")


def read_planes(sections: DataFrame, width: int, height: int, value: str = "r") -> DataFrame:
    """The residuals of plane_sections, a row a sample."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, x = np.divmod(np.arange(width * height), width)
        for frame in frames:
            for image, c, data in zip(frame["image_id"], frame["c"], frame["data"], strict=True):
                yield pd.DataFrame({"image_id": image, "c": c, "y": y, "x": x, value: read_plane(bytes(data), width, height).ravel()})

    return sections.select(*PLANE, "data").mapInPandas(run, f"image_id long, c long, y long, x long, {value} long")


#: First and last scanned coefficient of each pass.
PASSES = ((0, 0), (1, 15), (16, 63))


def block_sections(blocks: DataFrame, passes: tuple = PASSES) -> DataFrame:
    """image_id, c, pass and data, out of blocks (by, bx, scale, s: the scanned coefficients). The first pass carries the
    blocks' places and scales. Context 0 is the mean's, 1 all others'."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["by", "bx"])
        s, rows = np.stack(frame["s"].to_numpy()).astype(np.int64), []
        for p, (first, last) in enumerate(passes):
            part = s[:, first : last + 1]
            contexts = np.broadcast_to(np.arange(first, last + 1) > 0, part.shape).astype(np.int64)
            head = varint(len(s))
            if p == 0:
                head += b"".join(varint(int(v)) for b in zip(frame["by"], frame["bx"],
                    strict=True) for v in b) + frame["scale"].to_numpy("<f8").tobytes()
            rows.append((frame["image_id"].iloc[0], frame["c"].iloc[0], p, head + write_section(fold(part).ravel(), contexts.ravel())))
        return pd.DataFrame(rows, columns=["image_id", "c", "pass", "data"])

    return blocks.select(*PLANE, "by", "bx", "scale", "s").groupBy(*PLANE).applyInPandas(run, "image_id long, c long, pass int, data binary")


def read_blocks(sections: DataFrame, last_pass: int | None = None, passes: tuple = PASSES) -> DataFrame:
    """by, bx, scale and s of each block, from the passes up to last_pass (all by default); coefficients of the others are 0."""
    known = passes if last_pass is None else passes[: last_pass + 1]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        data = {int(p): bytes(d) for p, d in zip(frame["pass"], frame["data"], strict=True)}
        s = None
        for p, (first, last) in enumerate(known):
            reader, span = Reader(data[p]), last - first + 1
            n = reader.varint()
            if p == 0:
                places = [(reader.varint(), reader.varint()) for _ in range(n)]
                scale = np.frombuffer(reader.take(8 * n), "<f8")
                s = np.zeros((n, passes[-1][1] + 1), np.int64)
            symbols = read_section(data[p][reader.at :], lambda i, _, f=first, k=span: int(f + i % k > 0))
            s[:, first : last + 1] = unfold(np.array(symbols, np.int64)).reshape(n, span)
        return pd.DataFrame({"image_id": frame["image_id"].iloc[0], "c": frame["c"].iloc[0], "by": [b for b, _ in places],
            "bx": [b for _, b in places], "scale": scale, "s": list(s.astype(np.int32))})

    kept = sections.where(F.col("pass") < len(known))
    return kept.groupBy(*PLANE).applyInPandas(run, "image_id long, c long, by long, bx long, scale double, s array<int>")


def write_matches(symbols: list[int]) -> bytes:
    """Matches and literals as symbols of a section: 2 v a literal, 2 n + 1 a length (context 0), then its distance (1)."""
    out, contexts = [], []
    for literal, length, distance in matches(symbols):
        out += [2 * length + 1, distance] if length else [2 * literal]
        contexts += [0, 1] if length else [0]
    return write_section(np.array(out, np.int64), np.array(contexts, np.int64))


def read_matches(data: bytes) -> list[int]:
    def context(i: int, out: list[int]) -> int:
        nonlocal distance_next
        distance_next = bool(i) and not distance_next and out[-1] % 2 == 1
        return int(distance_next)

    distance_next = False
    flat, tokens, at = read_section(data, context), [], 0
    while at < len(flat):
        if flat[at] % 2:
            tokens.append((-1, flat[at] // 2, flat[at + 1]))
            at += 2
        else:
            tokens.append((flat[at] // 2, 0, 0))
            at += 1
    return unmatch(tokens)


def match_sections(symbols: DataFrame) -> DataFrame:
    """stream, n, coded (bytes of the section), exact (whether it reads back), of symbols (stream, pos, sym)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        syms = frame.sort_values("pos")["sym"].astype(int).tolist()
        data = write_matches(syms)
        return pd.DataFrame({"stream": [frame["stream"].iloc[0]], "n": [len(syms)], "coded": [len(data)], "exact": [read_matches(data) == syms]})

    return symbols.groupBy("stream").applyInPandas(run, "stream int, n long, coded long, exact boolean")


def tables_as_bytes(table: DataFrame, alphabet: int) -> DataFrame:
    """ctx, raw, runs and exact: each context's frequencies over the whole alphabet, in both forms, and whether both read
    back. A table has few rows, whatever the stream."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        freq = [0] * alphabet
        for s, f in zip(frame["sym"], frame["freq"], strict=True):
            freq[int(s)] = int(f)
        raw, runs = write_table(freq, False), write_table(freq, True)
        exact = read_table(Reader(raw)) == freq == read_table(Reader(runs))
        return pd.DataFrame({"ctx": [frame["ctx"].iloc[0]], "raw": [raw], "runs": [runs], "exact": [exact]})

    return table.select("ctx", "sym", "freq").groupBy("ctx").applyInPandas(run,
        f"ctx {dict(table.dtypes)['ctx']}, raw binary, runs binary, exact boolean")


def varint_column(n: Column) -> Column:
    """The varint of a long from 0 on, as bytes."""
    n = n.cast("long")
    byte = lambda v: F.unhex(F.lpad(F.hex(v), 2, "0"))
    group = lambda i: F.shiftright(n, 7 * i).bitwiseAND(F.lit(127))
    parts = [byte(group(i) + F.when(F.shiftright(n, 7 * (i + 1)) > 0, 128).otherwise(0)) for i in range(GROUPS)]
    return F.concat(parts[0], *[F.when(n >= 1 << 7 * i, p).otherwise(F.unhex(F.lit(""))) for i, p in enumerate(parts[1:], 1)])


def read_varint_column(data: Column) -> Column:
    byte = lambda i: F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10).cast("long")
    parts = [F.when(F.octet_length(data) > i, F.shiftleft(byte(i).bitwiseAND(F.lit(127)), 7 * i)).otherwise(F.lit(0).cast("long")) for i in range(GROUPS)]
    return sum(parts[1:], parts[0])
