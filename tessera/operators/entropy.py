"""Symbol statistics and entropy coding over (stream, pos, ctx, sym).

Counting, normalising and comparing histograms are aggregates; what carries a state from symbol to symbol (range coding,
match search) runs a stream at a time in Arrow batches, and streams are split by position so that there are many.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SLOTS = 4096
LOW, BITS = 1 << 16, 12


def histogram(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("ctx", "sym").agg(F.count(F.lit(1)).alias("n"))


def full_histogram(symbols: DataFrame, alphabet: int) -> DataFrame:
    """With a row for each symbol of the alphabet in each context."""
    every = symbols.select("ctx").distinct().select("ctx", F.explode(F.sequence(F.lit(0), F.lit(alphabet - 1))).alias("sym"))
    return every.join(histogram(symbols), ["ctx", "sym"], "left").select("ctx", "sym", F.coalesce("n", F.lit(0)).alias("n"))


def normalise(hist: DataFrame) -> DataFrame:
    """freq: shares of SLOTS, 1 at least for each symbol that occurs, summing to SLOTS exactly; cum: what comes before.

    Slots left over go round by falling count, in closed form. Slots given too many are taken off the largest
    frequencies, one each and again until the sum is right: the number each may give is known, so that too is a
    running sum, without a loop.
    """
    w = Window.partitionBy("ctx")
    order = w.orderBy(F.desc("n"), "sym")
    d = hist.where("n > 0").withColumn("total", F.sum("n").over(w)).withColumn("f",
        F.greatest(F.lit(1), F.expr(f"CAST(n * {SLOTS} AS LONG) div total")))
    d = d.withColumn("left", SLOTS - F.sum("f").over(w)).withColumn("rank", F.row_number().over(order)).withColumn("k", F.count(F.lit(1)).over(w))
    more = F.expr("`left` div k") + (F.col("rank") <= F.col("left") % F.col("k")).cast("int")
    spare = F.col("f") - 1
    before = F.coalesce(F.sum(spare).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    less = F.greatest(F.lit(0), F.least(spare, -F.col("left") - before))
    d = d.withColumn("freq", F.when(F.col("left") >= 0, F.col("f") + more).otherwise(F.col("f") - less).cast("long"))
    cum = F.sum("freq").over(w.orderBy("sym").rowsBetween(Window.unboundedPreceding, -1))
    return d.select("ctx", "sym", "n", "freq", F.coalesce(cum, F.lit(0)).cast("long").alias("cum"))


def slot_lookup(slots: DataFrame, table: DataFrame) -> DataFrame:
    """(ctx, slot) to sym. Tables have SLOTS slots a context, so each symbol's are listed and joined by equality."""
    listed = table.select("ctx", "sym", F.explode(F.sequence(F.col("cum"), F.col("cum") + F.col("freq") - 1)).alias("slot"))
    return slots.join(listed, ["ctx", "slot"])


def entropy_bits(table: DataFrame) -> DataFrame:
    """Ideal size in bits of each context's symbols under its normalised table."""
    return table.groupBy("ctx").agg(F.sum(-F.col("n") * F.log2(F.col("freq") / SLOTS)).alias("bits"), F.sum("n").alias("n"))


def divergence(hist: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence (natural logarithm) of each pair of contexts: a histogram has few rows, whatever the stream."""
    p = hist.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("ctx")))
    ids = hist.select("ctx").distinct()
    pairs = ids.select(F.col("ctx").alias("a")).join(ids.select(F.col("ctx").alias("b")), F.col("a") < F.col("b"))
    both = pairs.withColumn("ctx", F.explode(F.array("a", "b"))).join(p.select("ctx", "sym", "p"), "ctx")
    d = both.groupBy("a", "b", "sym").agg(F.coalesce(F.max(F.when(F.col("ctx") == F.col("a"), F.col("p"))), F.lit(0.0)).alias("p"),
        F.coalesce(F.max(F.when(F.col("ctx") == F.col("b"), F.col("p"))), F.lit(0.0)).alias("q"))
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / ((F.col("p") + F.col("q")) / 2))).otherwise(0.0)
    return d.groupBy("a", "b").agg(((F.sum(part("p")) + F.sum(part("q"))) / 2).alias("jsd"))


def closest_pair(hist: DataFrame) -> DataFrame:
    return divergence(hist).orderBy("jsd", "a", "b").limit(1)


def cluster(hist: DataFrame, most: int = 0, threshold: float = 0.1) -> DataFrame:
    """ctx to cluster: the closest pair merges until it is farther apart than the threshold and at most `most` are left.
    The contexts' histograms (contexts x alphabet rows) meet in one group; streams of any length have been counted before."""

    def jsd(a: np.ndarray, b: np.ndarray) -> float:
        if not a.sum() or not b.sum():
            return 0.0
        p, q = a / a.sum(), b / b.sum()
        m = (p + q) / 2
        kl = lambda x: float((x[x > 0] * np.log(x[x > 0] / m[x > 0])).sum())
        return (kl(p) + kl(q)) / 2

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        table = frame.pivot_table(index="ctx", columns="sym", values="n", aggfunc="sum", fill_value=0).sort_index()
        ids, held = list(table.index), {i: r.astype(float) for i, r in enumerate(table.to_numpy())}
        of = {i: i for i in held}
        limit = min(most, len(ids)) if most else len(ids)
        while len(held) > 1:
            keys = sorted(held)
            best, i, j = min((jsd(held[i], held[j]), i, j) for n, i in enumerate(keys) for j in keys[n + 1 :])
            if len(held) <= limit and best > threshold:
                break
            held[i] = held[i] + held.pop(j)
            of = {k: i if v == j else v for k, v in of.items()}
        names = {v: n for n, v in enumerate(sorted(set(of.values())))}
        return pd.DataFrame({"ctx": ids, "cluster": [names[of[i]] for i in range(len(ids))]})

    kind = dict(hist.dtypes)["ctx"]
    return hist.groupBy(F.lit(0).alias("g")).applyInPandas(run, f"ctx {kind}, cluster int")


def split_streams(symbols: DataFrame, ways: int = 4) -> DataFrame:
    """Interleaving: position modulo `ways` names the stream, and the rest is the place in it."""
    return symbols.withColumn("stream", (F.col("pos") % ways).cast("int")).withColumn("pos", F.expr(f"pos div {ways}"))


def _tables(frame: pd.DataFrame, by: str | None) -> dict:
    out = {}
    groups = frame.groupby(by) if by else [(0, frame)]
    for ctx, rows in groups:
        counts = np.bincount(rows["sym"].to_numpy(np.int64))
        out[ctx] = normalise_counts(counts)
    return out


def normalise_counts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """freq and cum of one histogram, by the rule of normalise()."""
    n = counts.astype(np.int64)
    here = np.flatnonzero(n)
    freq = np.zeros(len(n), np.int64)
    freq[here] = np.maximum(1, n[here] * SLOTS // n.sum())
    order = here[np.lexsort((here, -n[here]))]
    left = SLOTS - int(freq.sum())
    if left >= 0:
        freq[order] += left // len(order)
        freq[order[: left % len(order)]] += 1
    else:
        for i in order:
            take = min(int(freq[i]) - 1, -left)
            freq[i] -= take
            left += take
    return freq, np.concatenate([[0], np.cumsum(freq)[:-1]])


def rans_encode(symbols: list[int], contexts: list[int], tables: dict) -> bytes:
    """Range asymmetric numeral system: symbols last to first, a byte out whenever the state would overflow."""
    state, out = LOW, bytearray()
    for s, c in zip(reversed(symbols), reversed(contexts), strict=True):
        freq, cum = int(tables[c][0][s]), int(tables[c][1][s])
        while state >= (LOW >> BITS << 8) * freq:
            out.append(state & 255)
            state >>= 8
        state = (state // freq << BITS) + state % freq + cum
    return state.to_bytes(4, "big") + bytes(reversed(out))


def rans_decode(data: bytes, contexts: list[int], tables: dict) -> list[int]:
    lookup = {c: np.repeat(np.arange(len(f)), f) for c, (f, _) in tables.items()}
    state, at, out = int.from_bytes(data[:4], "big"), 4, []
    for c in contexts:
        slot = state & (SLOTS - 1)
        s = int(lookup[c][slot])
        state = int(tables[c][0][s]) * (state >> BITS) + slot - int(tables[c][1][s])
        while state < LOW and at < len(data):
            state, at = (state << 8) | data[at], at + 1
        out.append(s)
    return out


def _by_stream(symbols: DataFrame, schema: str, run: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    return symbols.groupBy("stream").applyInPandas(lambda frame: run(frame.sort_values("pos")), schema)


def rans_round_trip(symbols: DataFrame, by_context: bool = True) -> DataFrame:
    """For each stream: symbols, coded bytes, and whether decoding gives them back."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame if by_context else frame.assign(ctx=0)
        keys = {k: i for i, k in enumerate(sorted(frame["ctx"].unique()))}
        ctx = [keys[k] for k in frame["ctx"]]
        tables = _tables(frame.assign(g=ctx), "g")
        syms = frame["sym"].astype(int).tolist()
        data = rans_encode(syms, ctx, tables)
        return pd.DataFrame({"stream": [frame["stream"].iloc[0]], "n": [len(syms)], "coded": [len(data)],
            "exact": [rans_decode(data, ctx, tables) == syms]})

    return _by_stream(symbols, "stream int, n long, coded long, exact boolean", run)


def matches(symbols: list[int], window: int = 1024, least: int = 3) -> list[tuple[int, int, int]]:
    """Greedy (literal, length, distance): the longest earlier match in the window, the nearest start first tried last, so
    that of equal lengths the earliest found, farthest back, stands; matches may overlap themselves."""
    out, i, n = [], 0, len(symbols)
    where: dict[tuple, list[int]] = {}
    while i < n:
        best, dist = 0, 0
        for j in where.get(tuple(symbols[i : i + least]), []) if i + least <= n else []:
            if i - j > window:
                continue
            k = least
            while i + k < n and symbols[j + k] == symbols[i + k]:
                k += 1
            if k > best:
                best, dist = k, i - j
        step = best or 1
        out.append((-1, best, dist) if best else (symbols[i], 0, 0))
        for p in range(i, min(i + step, n - least + 1)):
            where.setdefault(tuple(symbols[p : p + least]), []).append(p)
        i += step
    return out


def unmatch(tokens: list[tuple[int, int, int]]) -> list[int]:
    out: list[int] = []
    for literal, length, distance in tokens:
        if length:
            for _ in range(length):
                out.append(out[-distance])
        else:
            out.append(literal)
    return out


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def match_round_trip(symbols: DataFrame) -> DataFrame:
    """For each stream: symbols, tokens, bytes of the tokens as varints, and whether they expand to the symbols."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        syms = frame["sym"].astype(int).tolist()
        tokens = matches(syms)
        size = sum(len(varint(2 * t[0])) if not t[1] else len(varint(2 * t[1] + 1)) + len(varint(t[2])) for t in tokens)
        return pd.DataFrame({"stream": [frame["stream"].iloc[0]], "n": [len(syms)], "tokens": [len(tokens)], "bytes": [size],
            "exact": [unmatch(tokens) == syms]})

    return _by_stream(symbols, "stream int, n long, tokens long, bytes long, exact boolean", run)


def table_bytes(table: DataFrame) -> DataFrame:
    """Size of each context's table as runs of equal frequencies: gaps and islands over the symbols."""
    w = Window.partitionBy("ctx").orderBy("sym")
    d = table.withColumn("new", (~F.lag("freq", 1).over(w).eqNullSafe(F.col("freq"))) | (F.lag("sym", 1).over(w) != F.col("sym") - 1))
    d = d.withColumn("island", F.sum(F.coalesce("new", F.lit(True)).cast("int")).over(w)).groupBy("ctx", "island",
        "freq").agg(F.count(F.lit(1)).alias("length"))
    return d.groupBy("ctx").agg(F.count(F.lit(1)).alias("runs"), F.sum("length").alias("symbols"))


def token_split(n: Column) -> Column:
    """Sixteen direct tokens, then a class by bit length."""
    return F.when(n < 16, n).otherwise(F.length(F.bin(n)) + 11)


