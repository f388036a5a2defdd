import random
import zlib
from collections import Counter
from itertools import combinations_with_replacement

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing as K
from tessera.llm import pieces as S
from tessera.llm import token_files as T
from tessera.llm import vocab as V
from tessera.llm.common import shared_dir

from .helpers import ODD, prose, table

TEXTS = [t for _, t in ODD if t] + prose(20, 9, 400) + ["a  b\n c  ", "\n\nfoo  bar\tbaz", "don't it's 'llama we're x's", "İstanbul ΑΣ σας",
    "é café.", "...", " \n", "x y"]


def plain(name, text):
    ids = Tokenizer.from_file(V.vocabulary_path(name)).encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, 2], "<u4").tobytes()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_encoding_is_the_tokenizers(name, monkeypatch):
    whole = [plain(name, t)[:-4] for t in TEXTS]
    assert V.encoder(name).encode(TEXTS) == whole
    monkeypatch.setattr(V, "CACHED", 40)  # generations come and go
    assert V.Encoder(V.vocabulary_path(name)).encode(TEXTS) == whole


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_random_texts_are_encoded_as_by_the_tokenizer(name):
    """Letters, marks, case pairs, punctuation, white space of all kinds and special tokens, beside each other."""
    rng = random.Random(11)
    signs = [*"abzAZ'''stremvlld019.,;:!?-_()# \n\t\r  ", *"éÉİıßẞÀÑŒǅΣςЖя漢字한글가ㄱ،٣½²Ⅳªµſﬁ̸́̇̈  　\u0085 ​‍"]
    signs += [*"\x1c\x1f\x0b\x0c\0\x7f­😀👩᠎﻿", "<|endoftext|>", "<|startoftext|>", "İ.", "'S", "  ", " '"]
    any_char = lambda: chr(rng.choice([rng.randrange(32, 128), rng.randrange(128, 0x600), rng.randrange(0x600, 0xD800),
        rng.randrange(0x1F000, 0x1FFFF)]))
    texts = ["İ.", "EN İYİ."]
    for i in range(6000):
        pick = any_char if i % 3 == 0 else lambda: rng.choice(signs)
        texts.append("".join(pick() for _ in range(rng.randint(1, 20))))
    want = Tokenizer.from_file(V.vocabulary_path(name)).encode_batch(texts, add_special_tokens=False)
    got = V.Encoder(V.vocabulary_path(name)).encode(texts)
    assert [t for t, w, g in zip(texts, want, got, strict=True) if np.array(w.ids, "<u4").tobytes() != g] == []


def test_very_long_texts(spark):
    """Without blanks, and with many lines: whole texts, not prefixes; long pieces stay out of the cache."""
    rows = [(1, "x" * 200_000), (2, "word and more\n" * 150_000), (3, None)]
    path = f"{shared_dir(spark)}/test-tokens-{random.random()}"
    T.write(table(spark, rows), path)
    want = {k: (len(plain(T.VOCABULARY, t)) // 4, zlib.crc32(plain(T.VOCABULARY, t))) for k, t in rows}
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in T.read(spark, path).collect()} == want
    check_packing(K.pack(table(spark, rows)).collect(), rows, K.VOCABULARY)
    assert all(r.round_trip for r in S.encode(table(spark, rows)).collect())
    e = V.Encoder(V.vocabulary_path(K.VOCABULARY))
    e.encode([t for _, t in rows])
    assert max(map(len, e)) <= V.LONGEST


def test_token_files(spark):
    rows = [r for r in ODD if r[0] != 5 and r[0] is not None] + [(5, "word")] + [(100 + i, t) for i, t in enumerate(TEXTS)]
    path = f"{shared_dir(spark)}/test-tokens-{random.random()}"
    T.write(table(spark, rows).repartition(3), path)
    at = 0
    got = {r.doc_id: r for r in T.read(spark, path).collect()}
    for k, t in sorted(rows):
        ids = plain(T.VOCABULARY, t)
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    dictionary = bytes(spark.read.parquet(path + "/dictionary").first().dictionary)
    f = T.TokenFile(bytes(spark.read.parquet(path + "/files").first().file), dictionary)
    assert f.ids(0)[-4:] == np.uint32(2).tobytes()
    with pytest.raises(ValueError):
        T.TokenFile(bytes(spark.read.parquet(path + "/files").first().file), b"other")


def test_null_keys_come_first_and_empty_table(spark):
    path = f"{shared_dir(spark)}/test-tokens-{random.random()}"
    T.write(table(spark, ODD), path)
    got = T.read(spark, path).collect()
    assert len(got) == len(ODD)
    assert {r.doc_id for r in got if r.start < 5} >= {None}
    T.write(table(spark, ODD).limit(0), path + "e")
    assert T.read(spark, path + "e").count() == 0


def check_packing(got, rows, name):
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for s in by.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= K.CAPACITY
    total = sum(r.length for r in got)
    docs = {}
    for r in got:
        docs.setdefault(r.doc_id, []).append(r)
    for k, t in rows:
        ids = plain(name, t)
        parts = sorted(docs[k], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        at = 0
        for r in parts:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4 and all(r.length == K.CAPACITY for r in parts[1:])
    return len(by), total


def test_packing(spark):
    rows = [(k, t) for k, t in ODD if k not in (None, 5)] + [(5, "word")] + [(100 + i, t) for i, t in enumerate(prose(150, 4, 1500))]
    n, total = check_packing(K.pack(table(spark, rows).repartition(3)).collect(), rows, K.VOCABULARY)
    assert n <= 1.03 * total / K.CAPACITY + 2
    assert K.pack(table(spark, rows).limit(0)).count() == 0
    assert K.pack(table(spark, ODD)).count() == len(ODD)


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_each_piece_once(seed):
    rng = random.Random(seed)
    h = {}
    for _ in range(10 ** (1 + seed % 5)):
        n = min(64, max(1, int(rng.lognormvariate(2.5, 1)))) if seed % 2 else rng.randint(1, 64)
        h[n] = h.get(n, 0) + 1
    used = {}
    for bin_, times in K.plan(h, 64):
        assert sum(n * k for n, k in bin_.items()) <= 64
        for n, k in bin_.items():
            used[n] = used.get(n, 0) + k * times
    assert used == h


def optimum(items, capacity):
    """The fewest sequences, by trying all places of each piece."""
    items, best = sorted(items, reverse=True), len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) + max(0, -(-(sum(items[i:]) + sum(bins) - capacity * len(bins)) // capacity)) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for size in set(bins):
            if size + items[i] <= capacity:
                j = bins.index(size)
                bins[j] += items[i]
                go(i + 1, bins)
                bins[j] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def test_plan_against_the_optimum():
    rng, more = random.Random(1), 0
    for _ in range(200):
        capacity = rng.choice([10, 20, 30])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 12))]
        least, got = optimum(items, capacity), sum(n for _, n in K.plan(Counter(items), capacity))
        assert got <= least + 1
        more += got > least
    assert more <= 4


def test_index_of_sums():
    rng = random.Random(2)
    for _ in range(50):
        stock = Counter(rng.choices(range(1, 15), k=rng.randint(1, 9)))
        index = K.Sums(stock, 30)
        for _ in range(4):
            for s in range(1, 31):
                for most in (1, 2, 3):
                    choices = (c for k in range(1, most + 1) for c in combinations_with_replacement(sorted(stock), k))
                    there = any(sum(c) == s and not Counter(c) - stock for c in choices)
                    got = index.of(s, most)
                    assert (got is not None) == there and (got is None or (sum(got) == s and not Counter(got) - stock))
            if stock:
                out = rng.choice(sorted(stock.elements()))
                stock -= Counter([out])
                index.take((out,), 1)


def test_plan_finds_exact_complements():
    assert sum(t for _, t in K.plan({1000: 5, 24: 5}, 1024)) == 5
    assert sum(t for _, t in K.plan({600: 4, 300: 4, 124: 4}, 1024)) == 4
    assert sum(t for _, t in K.plan({600: 4, 200: 4, 124: 4, 100: 4}, 1024)) == 4
    assert K.plan({}) == []


def test_pieces_against_brute_force(spark):
    p = S.pieces()
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=V.vocabulary_path(S.MODEL))
    names = {m.id_to_piece(i): i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}

    def brute(text):
        t = S.BLANK + text.replace(" ", S.BLANK)
        best = [0.0] + [float("-inf")] * len(t)
        for e in range(1, len(t) + 1):
            best[e] = best[e - 1] + p._unknown
            for s in range(max(0, e - 16), e):
                if t[s:e] in names:
                    best[e] = max(best[e], best[s] + p.scores[names[t[s:e]]])
        return best[-1]

    for t in [x[:120] for x in TEXTS]:
        ids = p.encode(t)
        unknown = 0
        cost, at, raw = 0.0, 0, ids.tolist()
        while at < len(raw):
            if m.is_byte(raw[at]):
                first = int(m.id_to_piece(raw[at])[3:5], 16)
                at += 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                unknown += 1
            else:
                cost += p.scores[raw[at]]
                at += 1
        assert np.isclose(cost + unknown * p._unknown, brute(t))
        assert p.decode(ids) == t
    got = S.encode(table(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r.round_trip for r in got)
    scores = {(r.doc_id, r.ids_crc32): r.score for r in got}
    for k, t in ODD:
        if t and len(t) <= 300:
            assert np.isclose(scores[k, zlib.crc32(p.encode(t).tobytes())], brute(t))
    assert S.encode(table(spark, ODD).limit(0)).count() == 0
    assert S.encode(table(spark, ODD), ids=True).where("size(ids) <> n_pieces").count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_merges_of_many_parts_are_the_models(name):
    """Parts of one length merged together, letters, repeats and any bytes, against the model a part at a time."""
    rng, e = random.Random(7), V.Encoder(V.vocabulary_path(name))
    assert e._merges.whole
    for size in (1, 2, 3, 7, 16, V.Merges.MOST):
        raw = [bytes(rng.choice([b"etaoin", b"a", bytes(range(256))][i % 3]) for _ in range(size)) for i in range(300)]
        ids, counts = e._merges.ids(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, size))
        want = [[t.id for t in e._model.tokenize("".join(e._letters[b] for b in x))] for x in raw]
        assert ids.tolist() == sum(want, []) and counts.tolist() == list(map(len, want))
