import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import license_scan as L

from ..oracle import SF
from .helpers import ODD, prose, table

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    at, labels = [], set()
    for phrase, label in L.BASE.items():
        p = phrase.encode().split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_against_brute_force(spark):
    p = prose(12, 5, 60)
    extra = ["Apache--License, MIT\nLicense; cc-by CC BY", "gnu general public license gnu general public licenses", "MIT license é license",
        "the apache", "license cc", "by cc by-sa 4.0"]
    rows = ODD + [(100 + i, a + " " + b) for i, (a, b) in enumerate((a, b) for a in p for b in extra)]
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.scan(table(spark, rows)).collect())
    assert got == Counter((k, *brute(t)) for k, t in rows)


def test_many_rules_all_gated():
    assert len(L.rules()) > 300
    for r in L.rules():
        assert all(len(k) > 1 for k in r.keywords)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("licensed under the gnu general public license, version 3", {"gpl-3.0"}),
        ("under the gnu lesser general public license version 2.1", {"lgpl-2.1"}),
        ("spdx-license-identifier: mpl-2.0", {"mpl-2.0"}),
        ("see https://creativecommons.org/licenses/by-nc-sa/4.0/", {"cc-by-nc-sa"}),
        ("released under the new bsd license.", {"bsd-3-clause"}),
        ("license: mit", {"mit"}),
        ("gnu general public license as published by the free software foundation; either version 3 of the license", {"gpl-3.0"}),
        ("spdx-license-identifier: mit or apache-2.0", {"mit", "apache-2.0"}),
        ("# spdx-license-identifier: (apache-2.0 and bsd-3-clause) with llvm-exception", {"apache-2.0", "bsd-3-clause", "llvm-exception"}),
        ("spdx-license-identifier: mit", {"mit"}),
        ("a reserved seat, all rights considered", set()),
        ("the public domain mark and the gnus", set()),
        ("", set()),
    ],
)
def test_detections(text, labels):
    assert {h[3] for h in L.detect(text)} == labels


def test_contained_detections_are_suppressed():
    hits = L.detect("licensed under the apache license version 2.0 and bsd license")
    assert [(h[3], h[2]) for h in hits] == [("apache-2.0", L.GRANT), ("bsd", L.NAME)]


def test_empty_table(spark):
    assert L.scan(table(spark, ODD).limit(0)).count() == 0


def all_rules(low):
    """Every rule without the gate, and each detection held against each other."""
    hits = sorted({h for r in L.rules() for h in L._hits(r, low)}, key=lambda h: (h[0], -h[1], h[3]))
    within = lambda h, g: g[0] <= h[0] and h[1] <= g[1]
    kept: list = []
    for level in sorted({h[2] for h in hits}, reverse=True):
        now = [h for h in hits if h[2] == level]
        same = [h for h in now if not any(within(h, g) and g[:2] != h[:2] for g in now)]
        kept += [h for h in same if not any(within(h, g) for g in kept)]
    return sorted(kept)


def sample(pattern, rng):
    """A string that the pattern may match; assertions are left out."""

    def one(items):
        out = ""
        for op, a in items:
            name = str(op)
            if name == "LITERAL":
                out += chr(a)
            elif name in ("NOT_LITERAL", "ANY"):
                out += "x"
            elif name == "IN":
                kind, v = rng.choice(a)
                out += chr(v if str(kind) == "LITERAL" else 32 if v[0] <= 32 <= v[1] else rng.choice(v))
            elif name == "BRANCH":
                out += one(rng.choice(a[1]))
            elif name == "SUBPATTERN":
                out += one(a[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                out += "".join(one(a[2]) for _ in range(rng.randint(a[0], min(a[1], a[0] + 2))))
            else:
                assert name.startswith("ASSERT")
        return out

    return one(re._parser.parse(pattern.pattern))


def test_gate_and_suppression_against_all_rules():
    rng = random.Random(4)
    rules = L.rules()
    texts, hit = [], 0
    for r in rules:
        texts += [sample(r.pattern, rng) for _ in range(2)]
    texts += [" and ".join(sample(rng.choice(rules).pattern, rng) for _ in range(5)) for _ in range(60)]
    for t in texts:
        want = all_rules(t)
        assert L.detect(t) == want, t
        raw = t.encode()
        assert not want or L._with_stems(raw, np.array([0, len(raw)])) == [0], t
        hit += bool(want)
    assert hit > 0.95 * len(texts)


def test_labels_and_score_over_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.labels, r.score) for r in L.scan(docs).collect()}
    for r in docs.collect():
        low = re.sub(r"[A-Z]", lambda m: m[0].lower(), r.text or "")
        found, base = all_rules(low), set(filter(None, brute(r.text)[4].split(",")))
        assert got[r.doc_id] == (",".join(sorted(base | {h[3] for h in found})), max([0.6 * bool(base), *(h[2] / 100 for h in found)]))


def test_very_long_text(spark):
    text = "word " * 400_000 + "Licensed under the MIT License. " * 3000 + "x" * 1_000_000
    r = L.scan(table(spark, [(1, text)])).first()
    assert (r.n_base, r.labels, r.score) == (3000, "mit", 0.6)


def test_many_hand_written_signatures():
    parts = [x for kinds in L.LICENSES.values() for kind in kinds for x in kind]
    assert len(set(parts)) == len(parts) > 300
