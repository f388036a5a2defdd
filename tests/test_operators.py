"""Round trips and axioms that SQL does not show."""

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import blocks as B
from tessera.operators import coding as K
from tessera.operators import entropy as E
from tessera.operators import motion as M
from tessera.operators import prediction as P
from tessera.operators import wavelet as W
from tessera.plans import QUERIES
from tessera.sources import containers as X
from tessera.sources import rasters as R


def as_set(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize(("w", "h"), [(1, 1), (5, 7), (64, 1), (1, 64), (16, 16)])
def test_wavelet_round_trip(spark, w, h):
    px = R.noise(spark, w, h, [42])
    assert as_set(W.inverse(W.forward(px, w, h), w, h), "c", "y", "x", "v") == as_set(px, "c", "y", "x", "v")


@pytest.mark.parametrize(("w", "h"), [(1, 1), (5, 7), (16, 9)])
def test_extended_tree_round_trip(spark, w, h):
    px = R.noise(spark, w, h, [7], 1)
    back = P.extended_rebuild(P.extended_residuals(px, w, h), w, h)
    assert as_set(back, "y", "x", "v") == as_set(px, "y", "x", "v")


def test_gradient_picture_has_no_residual(spark):
    px = R.grid(spark, 16, 16, 1).selectExpr("0L AS image_id", "c", "y", "x", "CAST(x + y AS INT) AS v")
    assert {r.r for r in P.gradient_predict(px, 16).where("x > 0 AND y > 0").collect()} == {0}


def test_dct_keeps_energy_and_comes_back(spark):
    for bw, bh in B.SIZES:
        px = R.noise(spark, bw, bh, [3], 1)
        blocks = B.extract(px, bw, bh)
        coef = np.array(B.dct(blocks, bw, bh).first().coef)
        raw = np.array(blocks.first().coef)
        assert np.isclose((coef**2).sum(), (raw**2).sum())
        assert np.allclose(B.idct(B.dct(blocks, bw, bh), bw, bh).first().coef, raw)


def test_scan_orders_are_permutations():
    assert sorted(B.zigzag_order()) == sorted(B.natural_order()) == list(range(64))
    assert B.zigzag_order()[:6] == [0, 1, 8, 16, 9, 2]


@pytest.mark.parametrize("counts", [[1], [0, 5, 0], [1] * 256, [10**6, 1, 1, 1], list(range(1, 200))])
def test_normalised_tables_fill_all_slots(spark, counts):
    freq, cum = E.normalise_counts(np.array(counts))
    assert freq.sum() == E.SLOTS
    assert all((f > 0) == (c > 0) for f, c in zip(freq, counts, strict=True))
    hist = spark.createDataFrame([("a", i, c) for i, c in enumerate(counts) if c], "ctx string, sym int, n long")
    got = {r.sym: (r.freq, r.cum) for r in E.normalise(hist).collect()}
    assert got == {i: (int(freq[i]), int(cum[i])) for i, c in enumerate(counts) if c}


def test_range_coder_and_matches():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 3000):
        s = rng.geometric(0.2, n).tolist()
        tables = {0: E.normalise_counts(np.bincount(s))}
        assert E.rans_decode(E.rans_encode(s, [0] * n, tables), [0] * n, tables) == s
        assert E.unmatch(E.matches(s)) == s
    assert E.matches([1, 2, 3] * 10)[-1] == (-1, 27, 3)


def test_varints_of_long_numbers(spark):
    numbers = sorted({0, 2**63 - 1} | {2 ** (7 * k) + d for k in range(1, 9) for d in (-1, 0, 1)})
    d = spark.createDataFrame([(n,) for n in numbers], "n long")
    coded = d.select("n", K.varint_column(F.col("n")).alias("data"), S.varint_bytes(F.col("n")).alias("size"))
    for r in coded.withColumn("back", K.read_varint_column(F.col("data"))).collect():
        assert (bytes(r.data), r.size, r.back) == (E.varint(r.n), len(E.varint(r.n)), r.n)


def test_varints_of_large_ids(spark, tmp_path):
    ids = [0, 11, 12, 185_363, 185_364, 6_000_000, 3_037_000_499]
    pq.write_table(pa.table({"event_id": ids}), tmp_path / "events.parquet")
    got = {r.event_id: (r.bytes, r.back) for r in QUERIES["varints"](spark, str(tmp_path)).collect()}
    assert got == {i: (E.varint(i * i).hex().upper(), i * i) for i in ids}
    got = {r.event_id: r.bytes for r in QUERIES["varint_length"](spark, str(tmp_path)).collect()}
    assert got == {i: len(E.varint(i * i)) for i in ids}


def test_boxes():
    small = (12).to_bytes(4, "big") + b"abcdWXYZ"
    large = (1).to_bytes(4, "big") + b"efgh" + (18).to_bytes(8, "big") + b"hi"
    assert X.parse(small + large) == [(0, "abcd", b"WXYZ"), (12, "efgh", b"hi")]
    for bad in (b"\0", b"\0\0\0\x04abcd", b"\0\0\0\x20abcd", b"\0\0\0\x01abcd"):
        with pytest.raises(ValueError):
            X.parse(bad)
    assert X.read_orientation(b"II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0\0\0\0\0") == 6
    assert X.read_orientation(None) == X.read_orientation(b"MM") == 1


def test_unreadable_container_gives_an_error_row(spark):
    files = spark.createDataFrame([(1, bytearray(b"\0\0\0\x20abcd"))], "file_id long, data binary")
    assert X.read_boxes(files).first().error == "box beyond the end"


def test_keyframes_follow_the_schedule(spark):
    frames = spark.range(60).withColumnRenamed("id", "frame_id")
    for interval, most in ((10, 3), (4, 9), (1, 5)):
        keys, last, deltas = [], None, 0
        for i in range(60):
            if last is None or i - last >= interval or deltas >= most:
                keys.append(i)
                last, deltas = i, 0
            else:
                deltas += 1
        assert sorted(r.frame_id for r in P.keyframes(frames, interval, most).where("is_key").collect()) == keys


def test_offsets_over_parts(spark):
    d = spark.range(100).selectExpr("id AS frame_id", "id % 7 AS duration")
    got = [r.start for r in M.offsets(d, "frame_id", "duration", 16).orderBy("frame_id").collect()]
    assert got == [sum(i % 7 for i in range(n)) for n in range(100)]


def test_noise_is_the_generators(spark):
    state, out = 42, []
    for _ in range(4):
        state, v = R.xorshift(state)
        out.append(v >> 56)
    assert [r.v for r in R.noise(spark, 2, 2, [42], 1).orderBy("y", "x").collect()] == out


@pytest.mark.parametrize(("width", "height", "levels"), [(13, 21, 3), (1, 9, 2), (8, 8, 3), (5, 1, 1), (17, 10, 2)])
def test_tiles_give_the_steps(spark, width, height, levels):
    """All levels in tiles are the steps one after the other, at any size, and come back."""
    rng = np.random.default_rng(width)
    values = rng.integers(-300, 300, (2, height, width))
    px = spark.createDataFrame([(7, c, y, x, int(values[c, y, x])) for c in range(2) for y in range(height) for x in range(width)],
        "image_id long, c long, y long, x long, v int")
    steps = reduce(lambda d, s: W.step(d, *s), W.step_plan(width, height, levels), px)
    rows = lambda d: sorted(tuple(r) for r in d.select("c", "y", "x", "v").collect())
    coded = W.forward(px, width, height, levels)
    assert rows(coded) == rows(steps)
    assert rows(W.inverse(coded, width, height, levels)) == rows(px)


@pytest.mark.parametrize("seed", range(4))
def test_planes_come_back_from_bytes(seed):
    rng = np.random.default_rng(seed)
    for most in (1, 5, 100, 70_000):
        h, w = rng.integers(1, 20, 2)
        r = rng.integers(-most, most + 1, (h, w)) if seed else np.zeros((h, w), np.int64)
        assert (K.read_plane(K.write_plane(r), w, h) == r).all()
        symbols = rng.integers(0, most % 50 + 2, int(rng.integers(0, 300))).tolist()
        assert K.read_matches(K.write_matches(symbols)) == symbols
        freq = rng.integers(0, 4, int(rng.integers(0, 40))).tolist()
        assert all(K.read_table(K.Reader(K.write_table(freq, k))) == freq for k in (None, True, False))


def test_truncated_sections_raise():
    data = K.write_plane(np.arange(64).reshape(8, 8))
    for n in (0, 1, 3):
        with pytest.raises(ValueError):
            K.read_plane(data[:n], 8, 8)


def test_extended_tree_against_single_samples(spark):
    """The walk over diagonals against one sample at a time."""
    rng = np.random.default_rng(5)
    values = np.where(rng.random((9, 12)) < 0.5, rng.integers(0, 40, (9, 12)), rng.integers(0, 4000, (9, 12)))
    r, ctx = P._plane_walk(values, P.EXTENDED_TREE, False)
    for y in range(9):
        for x in range(12):
            at = lambda a, dy, dx: int(a[y - dy, x - dx]) if y >= dy and x >= dx else 0
            n, w, nw = at(values, 1, 0), at(values, 0, 1), at(values, 1, 1)
            pn, pw = n if y else w, w if x else n
            pnw = nw if x and y else n if y else w
            props = {"gradient_h": abs(pw - pnw), "gradient_v": abs(pn - pnw), "w_nw": pw - pnw, "n_nw": pn - pnw}
            props["max_residual"] = max(abs(at(r, 1, 0)), abs(at(r, 0, 1)), abs(at(r, 1, 1)))
            t = P.EXTENDED_TREE
            while not isinstance(t, tuple):
                t = t.left if props[t.prop] <= t.threshold else t.right
            p = {"zero": 0, "west": w, "north": n, "gradient": max(0, min(65535, n + w - nw)), "select": w if abs(n - nw) < abs(w - nw) else n,
                "average_wnw": (w + nw) // 2, "average_nnw": (n + nw) // 2}[t[0]]
            assert (ctx[y, x], r[y, x]) == (t[1], values[y, x] - (p if x or y else 0))
    assert (P._plane_walk(r, P.EXTENDED_TREE, True)[0] == values).all()
