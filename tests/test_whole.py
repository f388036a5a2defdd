"""Queries do the whole job: no picture, vector, document or part of a text is left out."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.operators.metrics import byte_compare
from tessera.plans import ORACLE_SQL, QUERIES

from .oracle import rows

TEXT = "é" * 30 + "some text with ends, and then more of the same; " * 9
PICTURES = 11


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("whole")
    rng = np.random.default_rng(3)
    vectors = rng.uniform(-0.5, 0.5, (48 * PICTURES, 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(len(vectors)), "embedding": pa.array(list(vectors), pa.list_(pa.float32()))}),
        path / "embeddings.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([1, 30, 31], pa.int64()), "text": ["short", TEXT, "e" * 25]}), path / "documents.parquet")
    return str(path)


def pictures(folder):
    """image, c, y, x"""
    e = np.array(pq.read_table(f"{folder}/embeddings.parquet")["embedding"].to_pylist(), np.float32).astype(np.float64)
    v = np.clip(np.floor(e * 256 + 128.5), 0, 255).astype(int)
    return v.reshape(-1, 3, 4, 4, 8, 8).transpose(0, 1, 2, 4, 3, 5).reshape(-1, 3, 32, 32)


def test_ssim_of_every_picture(spark, folder):
    want = {}
    for i, a in enumerate(pictures(folder).astype(float)):
        s = []
        for y in range(25):
            for x in range(25):
                p = a[:, y : y + 8, x : x + 8].reshape(3, -1)
                q = p - p % 8
                mp, mq, cov = p.mean(1), q.mean(1), (p * q).mean(1) - p.mean(1) * q.mean(1)
                s.append((2 * mp * mq + 6.5025) / (mp**2 + mq**2 + 6.5025) * (2 * cov + 58.5225) / (p.var(1) + q.var(1) + 58.5225))
        want[i] = np.mean(s)
    got = {r.image_id: r.ssim for r in QUERIES["ssim"](spark, folder).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-4 for i in want)


@pytest.mark.parametrize("name", ["lossless_round_trip", "extended_tree_round_trip"])
def test_every_picture_comes_back(spark, folder, name):
    got = np.full((PICTURES, 3, 32, 32), -1)
    for r in QUERIES[name](spark, folder).collect():
        got[r.image_id, r.c, r.y, r.x] = r.v
    assert (got == pictures(folder)).all()


def test_whole_texts_are_compared(spark, folder):
    a, b = TEXT.encode(), TEXT[:-4].replace("e", "a").encode()
    got = {r.id: r for r in QUERIES["byte_compare"](spark, folder).collect()}
    assert len(got) == 3 and (got[30].size_a, got[30].size_b) == (len(a), len(b))
    assert got[30].differing == sum(x != y for x, y in zip(a, b, strict=False)) + len(a) - len(b) and got[30].first_offset == a.index(b"e")


def test_empty_texts_are_compared(spark, tmp_path):
    long = "é" + "no such letter, then one: e" * 40_000
    texts = ["", None, "abc", "no", "aé\0b..e.", "e" * 9, long]
    pq.write_table(pa.table({"doc_id": np.arange(len(texts)), "text": texts}), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    got = rows(QUERIES["byte_compare"](spark, str(tmp_path)).toArrow())
    assert got == rows(con.sql(ORACLE_SQL["byte_compare"]).to_arrow_table())


def test_bytes_of_ids_on_one_side_differ(spark):
    of = lambda *rows: spark.createDataFrame(rows, "id string, data binary")
    got = byte_compare(of(("a", b"\0\1"), ("b", b"")), of(("b", b"xyz"), ("c", None))).collect()
    assert sorted(map(tuple, got)) == [("a", 2, 0, 2, 0, 0.0), ("b", 0, 3, 3, 0, None), ("c", 0, 0, 0, -1, None)]


def test_first_20_differences_of_each_text(spark, folder):
    got = sorted((r.id, r.at, r.a, r.b) for r in QUERIES["byte_differences"](spark, folder).collect())
    places = [i for i, x in enumerate(TEXT.encode()) if x == ord("e")]
    assert len(places) > 20 and got == [(30, i, "65", "61") for i in places[:20]] + [(31, i, "65", "61") for i in range(20)]


def test_every_vector_is_in_the_product(spark, folder):
    e = np.array(pq.read_table(f"{folder}/embeddings.parquet")["embedding"].to_pylist(), np.float32).astype(np.float64)
    got = np.zeros((64, 64))
    for r in QUERIES["matrix_multiply"](spark, folder).collect():
        got[r.i, r.j] = r.v
    assert np.allclose(got, e.T @ e, atol=1e-4)


def test_whole_texts_are_payloads(spark, folder):
    data = TEXT.encode()
    one = lambda name: QUERIES[name](spark, folder).where("file_id = 30")
    assert one("box_bytes").first().bytes == ((len(data) + 8).to_bytes(4, "big") + b"xml " + data).hex().upper()
    assert one("container_round_trip").where("kind = 'jxlc'").first().size == len(data) + 2
    assert one("codestream").first().stream == (b"\xff\x0a" + data).hex().upper()
