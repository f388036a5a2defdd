import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import suffix_dedup as S

from .helpers import ODD, edited, prose, table


def brute(rows):
    raw = [(t or "").encode() for _, t in rows]
    n = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = []
    for (k, _), b in zip(rows, raw, strict=True):
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if n[b[i : i + 200]] > 1:
                cover[i : i + 200] = True
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        left = bytes(np.frombuffer(b, np.uint8)[~cover])
        out.append((k, len(b), int(cover.sum()), spans, hashlib.sha256(left).hexdigest()))
    return Counter(out)


def corpus():
    p = prose(14, 2, 300)
    shared = prose(1, 8, 120)[0].ljust(420, "q")
    more = [p[0], p[0], edited(p[1], 1), edited(p[1], 2, 60), p[2] + shared + p[3], shared, "x" + shared[3:390] + "é", "é" * 500, "ab" * 700,
        "abc" * 500 + shared[:250]]
    return ODD + [(100 + i, t) for i, t in enumerate(p + more)]


@pytest.mark.parametrize(("hot", "chunk"), [(S.HOT, S.CHUNK), (1, 32), (3, 7), (0, 200)])
def test_against_brute_force(spark, hot, chunk, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", chunk)
    rows = corpus()
    got = Counter(tuple(r) for r in S.dedup(table(spark, rows).repartition(3), hot=hot).collect())
    assert got == brute(rows)


def test_hot_passage(spark):
    """One passage in many texts, each with its own words around: cut on by chunks, and at its edges by strings."""
    passage = prose(1, 30, 200)[0].ljust(700, "p")[:700]
    around = prose(80, 31, 60)
    rows = [(i, around[i] + passage + around[-1 - i]) for i in range(40)]
    assert Counter(tuple(r) for r in S.dedup(table(spark, rows), hot=8).collect()) == brute(rows)


def test_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "PART", 700)
    text = prose(1, 6, 4000)[0] * 2
    rows = [(1, text), (2, text[5000:9000])]
    d = np.frombuffer(text.encode(), np.uint8)
    whole = S.anchors(d, np.array([0, len(d)]))
    assert int(whole[3].sum()) == len(d) - S.WINDOW + 1
    assert Counter(tuple(r) for r in S.dedup(table(spark, rows)).collect()) == brute(rows)


def test_kept_text_has_whole_characters(spark):
    body = "é" * 150
    rows = [(1, "ab" + body + "ü"), (2, "cd" + body + "ö"), (3, None)]
    assert {r.doc_id: r.text for r in S.remove(table(spark, rows)).collect()} == {1: "abü", 2: "cdö", 3: None}


def test_removal_keeps_rows_and_columns(spark):
    """int keys, repeated rows, null keys and columns named like the operator's own."""
    rows = corpus()
    d = table(spark, rows).selectExpr("CAST(doc_id AS INT) AS doc_id", "text", "1 AS __row", "2 AS __MARKS", "3 AS `a.b`", "map('x', 1) AS m")
    out = S.remove(d)
    assert out.schema == d.schema
    got = Counter((r.doc_id, len((r.text or "").encode()), r["__row"], r["__MARKS"], r["a.b"]) for r in out.collect())
    want = Counter()
    for (k, n, gone, _, _), c in brute(rows).items():
        want[k, n - gone, 1, 2, 3] += c
    different = (got - want) + (want - got)
    assert all("é" in t for k, t in rows if k in {k for k, *_ in different})  # cut characters come back whole
    assert S.remove(d.limit(0)).count() == 0


def test_suffix_array_and_prefixes():
    rng = random.Random(3)
    for trial in range(60):
        n = rng.randint(1, 500)
        raw = b"a" * n if trial % 5 == 0 else bytes(rng.choice(b"ab\0" if trial % 2 else bytes(range(256))) for _ in range(n))
        data = np.frombuffer(raw, np.uint8)
        order = S.suffix_array(data)
        keys = [raw[i : i + S.WINDOW] for i in order]
        assert sorted(order.tolist()) == list(range(n)) and keys == sorted(keys)
        wanted = np.array([rng.random() < 0.3 for _ in range(n)]) if trial % 3 else np.arange(n) < n // 3
        part = S.suffix_array(data, wanted)
        part = part[wanted[part]]
        assert sorted(part.tolist()) == np.flatnonzero(wanted).tolist()
        assert [raw[i : i + S.WINDOW] for i in part] == [k for k, i in zip(keys, order, strict=True) if wanted[i]]
        lcp = S.adjacent_prefixes(order, data)
        for i in range(1, n):
            a, b = keys[i - 1], keys[i]
            assert lcp[i] == next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_empty_table(spark):
    assert S.dedup(table(spark, ODD).limit(0)).count() == 0
