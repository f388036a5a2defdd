from collections import defaultdict

import pytest

from tessera.llm import exact_dedup as D

from .helpers import ODD, prose, table


@pytest.mark.parametrize("counters", [1, 4, 1024])
def test_against_groups(spark, counters):
    texts = prose(20, 1, 20)
    rows = ODD + [(100 + i, texts[i % 7 if i % 3 else 0]) for i in range(90)]
    got = D.mark_copies(table(spark, rows), counters=counters).select("doc_id", "text", "__xd.*").collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for k, t in rows:
        groups[t or ""].append(k)
    kept = defaultdict(int)
    for r in got:
        keys = groups[r.text or ""]
        assert r.group_size == len(keys)
        assert r.keep_id == max((k for k in keys if k is not None), default=None)
        kept[r.text or ""] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_keeps_columns_and_takes_an_empty_table(spark):
    d = table(spark, ODD)
    out = D.drop_copies(d)
    assert out.columns == d.columns
    assert D.drop_copies(d.limit(0)).count() == 0


def test_hot_rows_with_clashing_columns(spark):
    """A third of the rows equal in key and text, and another third in text alone; columns named like the operator's own."""
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, "hot" if i % 3 < 2 else f"cold {i}") for i in range(600)]
    d = table(spark, rows).repartition(9).selectExpr("CAST(doc_id AS INT) AS doc_id", "text", "1 AS __xd", "2 AS __xd_digest", "3 AS __XD_N",
        "4 AS `a.b`", "map('x', 1) AS m")
    out = D.mark_copies(d, counters=4)
    got = out.select("doc_id", "text", "__xd", "__xd_digest", f"{out.columns[-1]}.*").collect()
    assert out.columns[:-1] == d.columns and len(got) == 600
    assert all((r["__xd"], r["__xd_digest"]) == (1, 2) for r in got)
    assert [(r.doc_id, r.group_size) for r in got if r.text == "hot" and r.kept] == [(7, 400)]
    assert all(r.keep_id == 7 for r in got if r.text == "hot") and all(r.kept for r in got if r.text != "hot")
    kept = D.drop_copies(d, counters=4)
    assert kept.schema == d.schema and kept.count() == 201


def test_very_long_text(spark):
    rows = [(1, "x" * 5_000_000), (2, "x" * 5_000_000), (3, "y" * 4_999_999)]
    assert sorted(r.doc_id for r in D.drop_copies(table(spark, rows)).collect()) == [2, 3]


def test_summaries_find_every_heavy_digest(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"cold {i}") for i in range(600)]
    d = table(spark, rows).repartition(7)
    assert [(n, k) for _, n, k in D.heavy_groups(d, counters=4)][:1] == [(200, 597)]
