import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import jaccard_join as J

from .helpers import ODD, edited, prose, table

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").encode().lower() if (text or "").isascii() else re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    link = [[bool(a) and bool(b) and len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets]
    group = list(range(n))
    for _ in range(n):
        new = [min(group[j] for j in range(n) if link[i][j]) if any(link[i]) else group[i] for i in range(n)]
        if new == group:
            break
        group = new
    out = []
    for i, (k, _) in enumerate(rows):
        if not sets[i]:
            out.append((k, k, k, 0))
            continue
        ids = lambda js: min((rows[j][0] for j in js if rows[j][0] is not None), default=None)
        out.append((k, ids([j for j in range(n) if sets[j] == sets[i]]), ids([j for j in range(n) if group[j] == group[i]]), sum(link[i]) - 1))
    return Counter(out)


def corpus():
    p = prose(25, 12, 200)
    near = [edited(t, s, 40) for t in p[:8] for s in range(5)]
    chain = [" ".join(f"w{i + j}" for i in range(60)) for j in range(0, 30, 3)]
    return ODD + [(100 + i, t) for i, t in enumerate(p + near + chain + [p[0], p[0].upper(), p[1] + " \n"])]


@pytest.mark.parametrize("block", [J.BLOCK, 3])
def test_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", block)
    rows = corpus()
    got = Counter(tuple(r) for r in J.join(table(spark, rows).repartition(3)).collect())
    assert got == brute(rows)


def test_one_of_each_group_stays(spark):
    rows = corpus()
    p = prose(3, 31, 90)
    rows += [(500, p[0]), (501, p[0] + " more"), (501, p[1]), (None, p[0] + " less"), (None, p[2]), (502, p[2] + " x"), (503, p[1] + " y"),
        (503, p[1] + " y")]
    kept = Counter((r.doc_id, r.text) for r in J.keep_one(table(spark, rows)).collect())
    sets = [shingles(t) for _, t in rows]
    linked = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    left, want = set(range(len(rows))), Counter()
    while left:
        group, todo = set(), [min(left)]
        while todo:
            i = todo.pop()
            if i not in group:
                group.add(i)
                todo += [j for j in left if sets[i] and linked(i, j)]
        left -= group
        want[rows[min(group, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))]] += 1
    ties = lambda c: Counter((k, len(shingles(t))) for k, t in c.elements())
    assert ties(kept) == ties(want)
    assert (501, p[1]) in kept and (None, p[2]) not in kept  # rows that share a key are told apart


def test_keep_one_takes_clashing_names(spark):
    d = table(spark, corpus()).selectExpr("*", "1 AS __row", "2 AS `__ROW_`", "3 AS `a.b`")
    out = J.keep_one(d)
    assert out.columns == d.columns and {(r["__row"], r["a.b"]) for r in out.collect()} == {(1, 3)}


def test_hot_group_in_blocks(spark, monkeypatch):
    """A large group of near copies is dealt over many pairs of blocks and loses no link."""
    monkeypatch.setattr(J, "BLOCK", 5)
    base = prose(1, 40, 400)[0] + " " + prose(1, 41, 400)[0]
    rows = [(i, edited(base, i, 60)) for i in range(60)] + [(100 + i, t) for i, t in enumerate(prose(20, 42, 80))]
    assert Counter(tuple(r) for r in J.join(table(spark, rows).repartition(5)).collect()) == brute(rows)


def test_very_long_text(spark):
    words = " ".join(f"w{i % 70001}" for i in range(400_000))
    rows = [(1, words), (2, words + " end"), (3, "z" * 3_000_000), (4, None)]
    assert Counter(tuple(r) for r in J.join(table(spark, rows)).collect()) == brute(rows)


def test_posterior_bound():
    least = J.least_matches()
    assert all(least[n] < 0.8 * n for n in least)
    rng = np.random.default_rng(0)
    lost = 0
    for _ in range(3000):  # pairs at the threshold are hardly ever dropped
        agree = rng.random(len(J._A)) < 0.8
        lost += any(agree[:n].sum() < m for n, m in least.items())
    assert lost == 0


def test_min_hash_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(1 << 63, size=3000, dtype=np.uint64))
    a, b = np.sort(x[:2400]), np.sort(x[600:])
    sig = J.min_hashes(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.1


def test_empty_table(spark):
    d = table(spark, ODD).limit(0)
    assert J.join(d).count() == 0 and J.keep_one(d).columns == d.columns
