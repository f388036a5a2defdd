"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over all pieces reads a text once; at each position its output links give every piece that
ends there, and each relaxes the best score of that position (Viterbi, without a second pass or a start table). Where no
piece begins with the blank sign inside, the best path of a text is that of its words, so words met before come from a
cache.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded, documents, slices
from .vocab import CACHED, LONGEST, vocabulary_path

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
#: What a character without a piece costs below the lowest score of all pieces; it is then written as bytes.
UNKNOWN = 10.0


class Pieces:
    """ids by the largest sum of piece scores. Of equal sums, the one whose last piece is longer stands, at each position."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.scores = np.array([model.get_score(i) for i in range(n)])
        self._byte, self._find, self._raw = {}, ahocorasick.Automaton(), []
        self._unk, names = model.unk_id(), []
        for i in range(n):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                self._byte[int(name[3:5], 16)] = i
                self._raw.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self._raw.append(b"")
            else:
                self._find.add_word(name, (len(name), i))
                self._raw.append(name.replace(BLANK, " ").encode())
                names.append(i)
        self._find.make_automaton()
        self._unknown = float(self.scores[names].min()) - UNKNOWN
        #: What an id adds to its path: a character written as bytes costs once, with its first byte.
        self.costs = self.scores.copy()
        self.costs[self._unk] = self._unknown
        for b, i in self._byte.items():
            self.costs[i] = 0.0 if b & 0xC0 == 0x80 else self._unknown
        #: A word is blanks and what follows them; pieces that go on over a word's end would join words.
        joins = any(BLANK in model.id_to_piece(i).lstrip(BLANK) for i in names)
        self._words = re.compile(r"(?s).+") if joins else re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self._cache: dict[str, bytes] = {}

    def _bytes_of(self, c: str) -> list[int]:
        return [self._byte[b] for b in c.encode()] if len(self._byte) == 256 else [self._unk]

    def best(self, word: str) -> list[int]:
        """The ids of a word, without the cache."""
        n = len(word)
        score, back = [0.0] + [float("-inf")] * n, [(0, -1)] * (n + 1)
        done = 0

        def close(to: int) -> None:  # positions where no piece ends take the character before them as bytes
            nonlocal done
            while done < to:
                done += 1
                s = score[done - 1] + self._unknown
                if s > score[done]:
                    score[done], back[done] = s, (1, -1)

        for end, (size, i) in self._find.iter(word):
            close(end)
            s = score[end + 1 - size] + self.scores[i]
            if s > score[end + 1]:
                score[end + 1], back[end + 1] = s, (size, i)
        close(n)
        out: list[int] = []
        while n:
            size, i = back[n]
            out += [i] if i >= 0 else self._bytes_of(word[n - 1])[::-1]
            n -= size
        return out[::-1]

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of BLANK and the text with its blanks as BLANK; an empty or null text has none."""
        if not text:
            return np.zeros(0, "<u4")
        words = self._words.findall(BLANK + text.replace(" ", BLANK))
        known = self._cache
        try:
            raw = b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > CACHED:
                known.clear()
            parts = []
            for w in words:
                x = known.get(w)
                if x is None:
                    x = np.array(self.best(w), "<u4").tobytes()
                    if len(w) <= LONGEST:
                        known[w] = x
                parts.append(x)
            raw = b"".join(parts)
        return np.frombuffer(raw, "<u4")

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self._raw.__getitem__, ids.tolist()))
        return raw.decode(errors="replace").removeprefix(" ")


@cache
def pieces(name: str = MODEL, folder: str | None = None) -> Pieces:
    return Pieces(vocabulary_path(name, folder))


_SCHEMA = "doc_id long, n_pieces long, ids_crc32 long, score double, decoded_sha256 string, round_trip boolean"


def encode(docs: DataFrame, model: str = MODEL, folder: str | None = None, text: str = "text", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """A row each: number of ids, their checksum (of little-endian uint32), the path's score, the SHA-256 of the
    text decoded from them, whether it equals the text, and with ids=True the ids.

    A null or empty text has no ids, decodes to the empty text and comes back whole. Null keys stay null, repeated rows
    are encoded each, other columns are not read, an empty table gives no rows. A BLANK sign in a text decodes to a
    blank, the one case in which round_trip is false. `score` is that of the best path, a
    character written as bytes included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model, folder)
        for batch in batches:
            for part in slices(batch, "t", 1 << 22):
                out = []
                for t in part.column("t").to_pylist():
                    x = p.encode(t)
                    back = p.decode(x)
                    out.append((len(x), zlib.crc32(x.tobytes()), float(p.costs[x].sum()), hashlib.sha256(back.encode()).hexdigest(),
                        back == (t or ""), x))
                columns = list(zip(*out, strict=True)) if out else [[]] * 6
                arrays = [pa.array(c, t) for c, t in zip(columns[:5], (pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.bool_()), strict=True)]
                if ids:
                    arrays.append(pa.array([x.astype(np.int32) for x in columns[5]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([part.column("k"), *arrays],
                    names=["doc_id", "n_pieces", "ids_crc32", "score", "decoded_sha256", "round_trip", *["ids"] * ids])

    bounded(docs.sparkSession)
    return docs.selectExpr(f"cast(`{key}` AS long) AS k", f"`{text}` AS t").mapInArrow(run, _SCHEMA + ", ids array<int>" * ids)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir))
