"""Encoding of whole texts piece by piece through a cache.

A text is cut before each run of white space that follows another character. Both kinds of tokenizer here split there
themselves, whatever stands beside the cut, so the pieces' ids, one after the other, are the text's. A piece met before
costs a look-up. A new piece goes through the tokenizer's own steps: its normalizer and its pre-tokenizer split it, and
its BPE model encodes the parts. For Latin-1, where these steps are a lower-casing and the pattern below, `re` does them,
and the model's merges are applied to all new parts of some texts at once; pieces that hold a special token go through the
tokenizer as a whole.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np

#: Pieces kept in each Python worker, in two generations, none of more than LONGEST characters: some 250 bytes each.
#: Bounds memory, not results.
CACHED, LONGEST = 400_000, 48
#: Characters of the texts whose new pieces are encoded together; a longer text is alone.
TOGETHER = 1 << 21
FOLDER = "/opt/tokenizers"

#: White space, as the tokenizers see it: not the separators x1C to x1F, which Python's \s has too.
_PIECES = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
_WORDS = re.compile(r"[\S\x1c-\x1f]+")
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
#: Latin-1 without its control characters but white space, and without the white space above ASCII.
_LATIN = re.compile(r"[\t-\r -~¡-ÿ]+")
# fixed values: the two tokenizers' own patterns, with \p{L} and \p{N} written out for Latin-1
_LATIN_BYTES = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+| ?[0-9²³¹¼-¾]+| ?[^\sA-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼-¾]+|\s+(?!\S)|\s+", re.ASCII)
_LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼-¾]+", re.ASCII)


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """The file of a public tokenizer. Executors find it through the installed package, as the driver does."""
    if folder:
        return f"{folder}/{name}"
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return f"{FOLDER}/{name}"
    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 stands for itself, all others for 256 upward."""
    printable = [b for b in range(256) if 33 <= b <= 126 or (161 <= b and b != 173)]
    out = {b: chr(b) for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


class Merges:
    """The merges of a BPE model over bytes, applied to many parts at once: in each round every part that still has a pair
    to merge merges the first one of its lowest rank, as the model does."""

    _NONE, _OPEN = 1 << 30, 1 << 29
    #: Bytes of a part at most (places take six bits beside the rank), and how many parts of a length are worth the arrays.
    MOST, FEWEST = 40, 24

    def __init__(self, path: str, letters: dict[int, str]):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        # what takes more than merges is left to the model itself
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
        self.whole = plain and all(c + e in vocab for c in letters.values() for e in ("", end)) and len(model["merges"]) < 1 << 22
        if not self.whole:
            return
        self._inner, self._last = (np.array([vocab[letters[b] + e] for b in range(256)], np.int32) for e in ("", end))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self._into = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self._bits = max(8, (4 * len(keys)).bit_length())
        self._keys, self._ranks = np.full(1 << self._bits, -1, np.int64), np.full(1 << self._bits, self._NONE, np.int32)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slots(keys).tolist(), strict=True)):
            while self._keys[at] not in (-1, key):
                at = (at + 1) % len(self._keys)
            self._keys[at], self._ranks[at] = key, rank
        # of two bytes, inside a part and at its end
        left = np.repeat(self._inner, 256)
        self._first = [self._pairs(left, np.tile(right, 256), 0).astype(np.int32) for right in (self._inner, self._last)]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray, place: np.ndarray | int) -> np.ndarray:
        """Rank and place of pairs in one number, _NONE where there is no merge; a right side of -1 is none."""
        keys = left.astype(np.int64) << 32 | right
        at = self._slots(keys)
        found = self._keys[at]
        rank = np.where((found == keys) & (right >= 0), self._ranks[at], self._NONE)
        todo = np.flatnonzero((found != keys) & (found >= 0) & (right >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) % len(self._keys)
            found = self._keys[at[todo]]
            hit = found == keys[todo]
            rank[todo[hit]] = self._ranks[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return np.where(rank < self._NONE, rank << 6 | place, self._NONE)

    def ids(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """raw: a part a row, all of one length. The parts' ids, one after the other, and how many each has."""
        n, size = raw.shape
        symbols = np.empty((size + 1, n), np.int32)  # a place a row; the last row ends all parts
        symbols[: size - 1], symbols[size - 1], symbols[size] = self._inner[raw.T[:-1]], self._last[raw.T[-1]], -1
        keys = np.full((size, n), self._NONE, np.int32)  # of the pair that begins at each place
        for i in range(size - 1):
            keys[i] = self._first[i == size - 2][raw[:, i].astype(np.int32) << 8 | raw[:, i + 1]] + i
        out, of = np.full((size, n), -1, np.int32), np.arange(n)
        while len(of):
            best = keys.min(axis=0)
            open_ = best < self._OPEN
            if not open_.all():
                done, open_ = np.flatnonzero(~open_), np.flatnonzero(open_)
                out[: len(keys), of[done]] = symbols[:-1].take(done, axis=1)
                of, symbols, keys, best = of[open_], symbols.take(open_, axis=1), keys.take(open_, axis=1), best[open_]
            if not len(of):
                break
            place, column = best & 63, np.arange(len(of))
            symbols[place, column] = self._into[best >> 6]
            # all parts here merged, so all are shorter by one place
            for i in range(1, len(keys)):
                moved = place < i
                np.copyto(symbols[i], symbols[i + 1], where=moved)
                if i < len(keys) - 1:
                    np.copyto(keys[i], keys[i + 1] - 1, where=moved)
            symbols, keys = symbols[:-1], keys[:-1]
            symbols[-1] = -1
            keys[place, column] = self._pairs(symbols[place, column], symbols[place + 1, column], place)
            column = np.flatnonzero(place)
            place = place[column] - 1
            keys[place, column] = self._pairs(symbols[place, column], symbols[place + 1, column], place)
        there = out.T >= 0
        return out.T[there], there.sum(axis=1)


class Encoder(dict):
    """ids of texts as little-endian uint32 bytes, equal to the tokenizer's with add_special_tokens=False. It is itself the
    cache, piece to ids: what some texts lack is filled in before their pieces are looked up."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._letters = _byte_letters()
        self._merges = Merges(path, self._letters)
        specials = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, specials)) or r"(?!)")
        self._letters_special = any(map(str.isalpha, specials))
        #: Tokenizers that drop white space and lower letters have a normalizer; the others keep all bytes.
        self._words = self._tokenizer.normalizer is not None
        self._old: dict[str, bytes] = {}
        self._parts: dict[str, bytes] = {}

    def _model_ids(self, part: str) -> bytes:
        return array("I", [t.id for t in self._model.tokenize(part)]).tobytes()

    def _fill(self, pieces: set[str]) -> list[str]:
        """Puts the pieces and their parts into the cache; gives back those too long to stay there."""
        old, special, latin, split = self._old, self._special.search, _LATIN.fullmatch, (_LATIN_WORDS if self._words else _LATIN_BYTES).findall
        several, parts, words = [], set(), self._words
        new = [p for p in pieces if p not in self]
        for p in new:
            held = old.get(p)
            if held is not None:
                self[p] = held
            elif p.isalpha() and p.isascii() and not self._letters_special:
                low = p.lower() if words else p
                parts.add(low)
                if low != p:
                    several.append((p, (low,)))
            elif special(p):
                self[p] = array("I", self._tokenizer.encode(p, add_special_tokens=False).ids).tobytes()
            elif p.isascii() or latin(p):
                of = split(p.lower() if words else p)
                parts.update(of)
                if len(of) != 1 or of[0] != p:
                    several.append((p, of))
            else:
                q = self._tokenizer.normalizer.normalize_str(p) if words else p
                self[p] = b"".join([self._part(x) for x, _ in self._tokenizer.pre_tokenizer.pre_tokenize_str(q)])
        sized: dict[int, list[str]] = {}
        for x in parts:  # a part is split no further
            if x not in self:
                held = old.get(x)
                if held is None:
                    sized.setdefault(len(x) if x.isascii() else len(x.encode()), []).append(x)
                else:
                    self[x] = held
        for size, same in sized.items():
            if self._merges.whole and size <= Merges.MOST and len(same) >= Merges.FEWEST:
                ids, counts = self._merges.ids(np.frombuffer("".join(same).encode(), np.uint8).reshape(-1, size))
                ids, at = ids.astype("<u4").tobytes(), 0
                for x, end in zip(same, (4 * np.cumsum(counts)).tolist(), strict=True):
                    self[x], at = ids[at:end], end
            else:
                for x in same:
                    self[x] = self._model_ids("".join([self._letters[b] for b in x.encode()]))
        for p, of in several:
            self[p] = b"".join([self[x] for x in of])
        return [*{p for p in new if len(p) > LONGEST}.union(x for size, same in sized.items() if size > LONGEST for x in same if len(x) > LONGEST)]

    def _part(self, x: str) -> bytes:
        """Of a part in the stand-ins of its bytes."""
        held = self._parts.get(x)
        if held is None:
            held = self._model_ids(x)
            if len(x) <= LONGEST:
                if len(self._parts) >= CACHED // 4:
                    self._parts.clear()
                self._parts[x] = held
        return held

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Null counts as empty."""
        out: list[bytes] = []
        collects = gc.isenabled()
        gc.disable()  # what is made here has no cycles, and each collection would go through the whole cache
        try:
            self._encode(texts, out)
        finally:
            if collects:
                gc.enable()
        return out

    def _encode(self, texts: list[str | None], out: list[bytes]) -> None:
        ids = self.__getitem__
        for some in _together(texts):
            # where white space is dropped, pieces need none
            cut = [_PIECES.findall(t) if not self._words else _WORDS.findall(t) if _SEPARATORS.search(t) else t.split() for t in some]
            long = self._fill(set().union(*cut))
            out += [b"".join(map(ids, pieces)) for pieces in cut]
            for p in long:
                del self[p]
            if len(self) > CACHED // 2:
                # what is still in use comes back from the generation before, the rest goes with it
                self._old = dict(self)
                self.clear()


def _together(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in groups of TOGETHER characters."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t or "") > TOGETHER:
            yield group
            group, size = [], 0
        group.append(t or "")
        size += len(t or "")
    if group:
        yield group


@cache
def encoder(name: str, folder: str | None = None) -> Encoder:
    """One for a process: Spark reuses its Python workers, and so the cache lives on from task to task."""
    return Encoder(vocabulary_path(name, folder))
