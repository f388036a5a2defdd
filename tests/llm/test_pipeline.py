"""The pipeline against its stages' brute-force forms, the SQL of the corpus queries, and the entry's guard."""

import os
import shutil
import subprocess
import sys
from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm import registry
from tessera.llm.common import trimmed

from ..oracle import SF, connection, rows
from . import test_jaccard_join, test_quality_rules, test_suffix_dedup
from .helpers import ODD, edited, prose, table
from .test_tokens import check_packing

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def corpus():
    p = [" ".join(t.split()) + "." for t in prose(80, 21, 200) if len(t.split()) > 100]
    passage = next(" ".join(t.split()) for t in prose(40, 22, 150) if len(t.split()) > 110) + "."
    more = [p[0], edited(p[1], 3, 60), p[2] + "\n" + passage, p[3] + "\n" + passage, "Home | News | Sport | More\n" + p[4], "a | b | c | d\n" * 30,
        p[5] + "\n" + p[5]]
    return [(k, t) for k, t in ODD if k != 5] + [(100 + i, t) for i, t in enumerate(p + more)]


def test_stages(spark):
    data = corpus()
    docs = table(spark, data)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, SF)
        if name == "best-fit packing":
            check_packing(out.collect(), before, "byte_bpe_50k.json")
            continue
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.columns == columns
        after = Counter((r.doc_id, r.text) for r in docs.collect())
        if name == "quality rules":
            assert Counter(k for k, _ in after.elements()) == Counter(k for k, t in before if test_quality_rules.brute(t)[6])
        elif name == "exact dedup":
            assert after == Counter((max(k for k, u in before if u == t), t) for t in {t for _, t in before})
        elif name == "n-gram Jaccard join":
            groups = test_jaccard_join.brute(before)
            assert Counter(k for k, _ in after.elements()) == Counter(k for k, _, g, _ in groups if k == g)
        else:
            want = {k: (n, gone) for k, n, gone, _, _ in test_suffix_dedup.brute(before)}
            assert {k: len(t.encode()) for k, t in after} == {k: n - gone for k, (n, gone) in want.items()}
            assert any(gone for _, gone in want.values())


def test_stages_take_odd_tables(spark):
    """Narrow keys, repeated rows and keys, null keys and texts, a very long text, columns named like the operators' own;
    and no rows at all."""
    long_text = "\n".join(f"Line {i} has some words of its own, number {i * 7919 % 100003}." for i in range(60_000))
    data = corpus() + [(5, "word"), (5, "word"), (700, long_text), (701, long_text), (702, long_text + " End."), (100, prose(1, 77, 90)[0])]
    extra = "1 AS __row", "2 AS __kept", "3 AS __xd", "4 AS __xd_digest", "5 AS __marks", "6 AS `a.b`"
    docs = table(spark, data).selectExpr("CAST(doc_id AS INT) AS doc_id", "text", "lang", "source", "n_chars", *extra)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0
        if name == "best-fit packing":
            assert {r.doc_id for r in stage(spark, docs, SF).collect()} >= {700, 701, 702, None}
            continue
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes == empty.dtypes
        rows = out.collect()
        assert rows and all((r["__row"], r["__kept"], r["__xd"], r["__xd_digest"], r["__marks"], r["a.b"]) == (1, 2, 3, 4, 5, 6) for r in rows)
        assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
        left = Counter(r.doc_id for r in rows)
        if name == "exact dedup":
            assert (left[5], left[700], left[701], left[702]) == (1, 0, 1, 1)
        if name == "n-gram Jaccard join":
            assert (left[700], left[701], left[702]) == (1, 0, 0) and left[5] == 0 and left[4] == 1
        if name == "suffix-array dedup":
            assert len(rows) == len(data) and all(not r.text for r in rows if r.doc_id in (700, 701))


def test_run_gives_rows(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 0


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert rows(registry.QUERIES[name](spark, SF).toArrow()) == rows(connection().sql(registry.ORACLE_SQL[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_a_row_a_document_at_least(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= spark.read.parquet(f"{SF}/documents.parquet").count()


def test_entry_works_without_the_subpackage(tmp_path):
    for x in ("__spark_entry__.py", "tessera"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{x}") else shutil.copy)(f"{ROOT}/{x}", tmp_path / x)
    shutil.rmtree(tmp_path / "tessera/llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'dct8' in q and not any(k.startswith('op') and k[2:3].isdigit() for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_workers_give_memory_back():
    """What a task's arrays took does not stay with the worker for the next stages, though later memory lies above it."""
    pinned = []

    def run(batches):
        for b in batches:
            held = [bytes(50_000) for _ in range(4_000)]
            pinned.append(bytes(50_000))
            del held
            yield b

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    before = resident()
    assert list(trimmed(run)(iter([1]))) == [1]
    assert resident() < before + 100_000_000
