import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import lm_scoring as L

from .helpers import ODD, prose, table

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())


def held(k):
    return zlib.crc32(b"" if k is None else str(k).encode()) % 7 == 2


def corpus():
    return ODD + [(100 + i, t) for i, t in enumerate(prose(120, 7, 80, 300))]


@pytest.mark.parametrize("common", [L.COMMON, 5, 0])
def test_base_against_brute_force(spark, common):
    rows = corpus()
    tokens = [(k, [*WORD.findall(lower(t)), None]) for k, t in rows]
    c = Counter(w for k, ws in tokens if not held(k) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((k, held(k), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for k,
        ws in tokens)
    got = L.score(table(spark, rows).repartition(3), common=common).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def brute_model(texts, depth):
    """The recursion on dictionaries, all contexts kept."""
    counts = defaultdict(lambda: [0, 0])
    for t in texts:
        padded = b"\0" * depth + t
        for i in range(depth, len(padded)):
            bits = f"{padded[i]:08b}"
            for d in range(depth + 1):
                for j in range(8):
                    counts[padded[i - d : i], bits[:j]][int(bits[j])] += 1
    children = defaultdict(set)
    for ctx, bits in counts:
        if ctx:
            children[ctx[1:], bits].add(ctx)

    def weighted(ctx, bits):
        own = kt(*counts[ctx, bits])
        if len(ctx) == depth:
            return own
        return np.logaddexp(own, sum(weighted(x, bits) for x in children[ctx, bits])) - math.log(2)

    def bit(ctx, bits):
        p, left = 0.0, 1.0
        for d in range(depth + 1):
            c = ctx[len(ctx) - d :]
            zero, one = counts.get((c, bits), (0, 0))
            share = math.exp(kt(zero, one) - math.log(2) - weighted(c, bits)) if d < depth and (c, bits) in counts else 1.0 if d == depth else 0.5
            p += left * share * (one + 0.5) / (zero + one + 1)
            left *= 1 - share
            if (c, bits) not in counts:  # nothing was seen here: one half at each deeper node too
                p += left * 0.5
                break
        return p

    def score(t):
        padded, total = b"\0" * depth + t, 0.0
        for i in range(depth, len(padded)):
            bits = f"{padded[i]:08b}"
            for j in range(8):
                p = bit(padded[i - depth : i], bits[:j])
                total += math.log10(p if bits[j] == "1" else 1 - p)
        return total

    return score


def test_model_against_the_recursion(spark):
    rows = [(i, t) for i, t in enumerate(["abracadabra abba", "banana bandana", "a cab", "", "abacus"] * 3)]
    want = brute_model([lower(t) for k, t in rows if not held(k)], 2)
    for r in L.score(table(spark, rows), depth=2).collect():
        assert np.isclose(r.score, want(lower(dict(rows)[r.doc_id])), rtol=1e-4), r


@pytest.mark.parametrize("contexts", [1, 40, L.CONTEXTS])
def test_every_context_gives_a_distribution(spark, contexts):
    counts = L.count(table(spark, corpus()).selectExpr("false AS held", "text AS t"), 3).cache()
    tree = L.tree_of(counts, 3, contexts)
    assert np.allclose((10.0 ** tree.rows.astype(float)).sum(axis=1), 1, atol=1e-4)
    assert len(tree.rows) <= 2 * contexts + 2


@pytest.mark.parametrize("often", [L.GRAMS, 300, 0])
def test_all_contexts_count_whatever_is_cached(spark, often):
    """More contexts than CONTEXTS: scores are those of the tree of all of them."""
    rng = np.random.default_rng(5)
    rows = [(i, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 300))) for i in range(120)]
    docs = table(spark, rows)
    training = [r for r in rows if not held(r[0])]
    counts = L.count(table(spark, training).selectExpr("false AS held", "text AS t"), L.DEPTH).cache()
    tree = L.tree_of(counts, L.DEPTH, 10**9)
    assert len(tree.step) > L.CONTEXTS
    got = {r.doc_id: r.score for r in L.score(docs, often_grams=often).collect()}
    for k, t in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        assert np.isclose(got[k], tree.log10(L.grams(data, np.array([0, len(data)]), L.DEPTH)).sum(), rtol=1e-5), k


def test_held_out_accuracy_grows_with_depth(spark):
    rows = [(i, t) for i, t in enumerate(prose(200, 3, 200, 300))]
    bits = []
    for depth in (0, 2, 4):
        got = [r for r in L.score(table(spark, rows), depth=depth).collect() if r.held_out and r.bits_per_byte]
        bits.append(sum(r.score for r in got))
    assert bits[0] < bits[1] < bits[2]


def test_empty_table(spark):
    assert L.score(table(spark, ODD).limit(0)).count() == 0
    only_held = [(k, t) for k, t in ODD if held(k)]
    got = L.score(table(spark, only_held)).collect()
    assert len(got) == len(only_held) > 0 and all((r.train_tokens, r.n_known, r.held_out) == (0, 0, True) for r in got)
    # without training, each bit has the probability of a half
    assert all(np.isclose(r.score, -8 * len(lower(t)) * math.log10(2)) for r,
        (k, t) in zip(sorted(got, key=lambda r: r.doc_id), sorted(only_held), strict=True))


def test_very_long_text(spark):
    text = " ".join(f"w{i % 977}" for i in range(300_000))
    a, b, c = [k for k in range(100) if not held(k)][:3]
    rows = [(a, text), (b, "short text"), (c, None), (next(k for k in range(100) if held(k)), text[:1000])]
    got = [r for r in L.score(table(spark, rows)).collect()]
    assert all(np.isfinite(r.score) for r in got) and max(r.n_tokens for r in got) == 300_001
    assert all(r.bits_per_byte < 2 for r in got if r.n_tokens > 100) and [r.score for r in got if r.doc_id == c] == [0]
