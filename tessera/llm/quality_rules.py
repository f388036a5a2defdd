"""Quality rules, line first.

Each line with a word is held against the rules below; lines that fail are removed, and a document that loses more than
`MAX_LOST` of its words is rejected, as is one that fails the base rules on its whole text. Rules see bytes of UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import IN_WORD, bounded, counts_between, documents, map_rows, slices, span_hashes, text_bytes, word_bounds, trimmed

#: A document that loses more than this share of its words with its failed lines is rejected.
MAX_LOST = 0.5
#: A line of at least so many words must end like a sentence.
TITLE_WORDS = 4
#: A line with so many separators, one to four words at least, is navigation.
SEPARATORS = 2
#: A line with so many symbols, three to ten words at least, is not prose.
SYMBOLS = 3
#: A line with so many exclamation marks, one to two words at least, is shouting.
SHOUTS = 6

#: Phrases (lower case, ASCII) of lines that sites repeat on each page, in the corpus' four languages.
BOILERPLATE = (
    "accept cookies", "add to cart", "all rights reserved", "back to top", "click here", "cookie policy",
    "enable javascript", "follow us on", "forgot password", "javascript is disabled", "leave a comment", "log in to",
    "lorem ipsum", "powered by wordpress", "privacy policy", "read more", "share this", "sign in to", "sign up for",
    "skip to content", "subscribe to our", "terms of service", "terms of use", "uses cookies", "view all",
    "alle rechte vorbehalten", "cookies akzeptieren", "hier klicken", "in den warenkorb", "jetzt anmelden", "kommentar schreiben",
    "nach oben", "newsletter abonnieren", "passwort vergessen", "verwendet cookies", "weiterlesen", "zum inhalt springen",
    "accepter les cookies", "ajouter au panier", "aller au contenu", "cliquez ici", "haut de page", "laisser un commentaire",
    "lire la suite", "mot de passe perdu", "se connecter", "tous droits", "utilise des cookies", "voir tout",
    "aceptar cookies", "aviso legal", "deja un comentario", "haga clic", "ir al contenido", "leer todo", "seguir leyendo",
    "todos los derechos", "utiliza cookies", "ver todos", "volver arriba",
)

_SYMBOL, _SEPARATOR, _END = (np.isin(np.arange(256), list(x)) for x in (b"#*$%&|<>", b"|>", b".!?:;\"')]"))
#: The last three bytes of a line that ends in an ellipsis or a closing quote.
_LONG_ENDS = [np.frombuffer(x.encode(), np.uint8) for x in ("…", "”", "»")]


def _below(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines, and the document of each."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    # a text that ends in \n has an empty last line, which starts where the next text starts: equal starts keep order
    doc = np.repeat(np.arange(len(offsets) - 1), 1 + counts_between(breaks, offsets))
    return starts, ends, doc


def _phrase_lines(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which lines contain one of BOILERPLATE."""
    out = np.zeros(len(starts), dtype=bool)
    low = data.tobytes().lower()
    for phrase in BOILERPLATE:
        p, at = phrase.encode(), low.find(phrase.encode())
        while at >= 0:
            line = np.searchsorted(starts, at, "right") - 1
            out[line] |= line + 1 == len(starts) or at + len(p) <= starts[line + 1]
            at = low.find(p, at + 1)
    return out


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All counts and verdicts of the texts, and of the lines: line_start, line_end, line_doc, line_failed."""
    n = len(offsets) - 1
    starts, ends = word_bounds(data, offsets)
    n_words = counts_between(starts, offsets)
    chars = _below(IN_WORD[data] & (data & 0xC0 != 0x80))
    symbols = _below(_SYMBOL[data])
    out = {"n_words": n_words, "word_chars": np.diff(chars[offsets]), "n_symbols": np.diff(symbols[offsets])}

    ls, le, doc = _lines(data, offsets)
    first, last = np.searchsorted(starts, ls), np.searchsorted(starts, le)
    words = last - first
    full = np.flatnonzero(words)
    ls, le, doc, words, last = ls[full], le[full], doc[full], words[full], last[full]
    with np.errstate(over="ignore"):
        salt = doc.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        distinct = np.unique(span_hashes(data, ls, le) + salt, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(doc, minlength=n) - np.bincount(doc[distinct], minlength=n)

    h = span_hashes(data, starts, ends)
    word_doc = np.repeat(np.arange(n), n_words)
    repeated = np.zeros(len(h) + 1, dtype=np.int64)
    if len(h) > 2:
        window = np.flatnonzero(word_doc[2:] == word_doc[:-2])
        with np.errstate(over="ignore"):
            key = h[window] * np.uint64(3) + h[window + 1] * np.uint64(0x9E3779B97F4A7C15) + (h[window + 2] ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xC2B2AE3D27D4EB4F)
            key += word_doc[window].astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        order = np.argsort(key, kind="stable")
        same = np.zeros(len(key) + 1, dtype=bool)
        same[1:-1] = key[order][1:] == key[order][:-1]
        twice = window[order[same[1:] | same[:-1]]]
        np.add.at(repeated, twice, 1)
        np.add.at(repeated, np.minimum(twice + 3, len(h)), -1)
    out["n_repeat_words"] = np.diff(_below(np.cumsum(repeated)[:-1] > 0)[np.searchsorted(starts, offsets)])
    out["base_failed"] = (n_words < 50) | (100 * out["n_repeat_words"] > 50 * n_words)

    tail = ends[last - 1]
    closed = _END[data[tail - 1]]
    for x in _LONG_ENDS:
        fits = np.flatnonzero(tail - ls >= len(x))
        hit = np.ones(len(fits), dtype=bool)
        for i, b in enumerate(x):
            hit &= data[tail[fits] - len(x) + i] == b
        closed[fits[hit]] = True
    count = lambda below: below[le] - below[ls]
    n_symbols, separators, shouts = count(symbols), count(_below(_SEPARATOR[data])), count(_below(data == 0x21))
    failed = (~closed & (words >= TITLE_WORDS)) | ((n_symbols >= SYMBOLS) & (10 * n_symbols >= 3 * words))
    failed |= (separators >= SEPARATORS) & (4 * separators >= words)
    failed |= (shouts >= SHOUTS) & (2 * shouts >= words)
    failed |= _phrase_lines(data, ls)
    lost = np.bincount(doc, weights=words * failed, minlength=n)
    out["n_lost_words"] = lost.astype(np.int64)
    out["kept"] = ~out["base_failed"] & (lost <= MAX_LOST * n_words)
    return out | {"line_start": ls, "line_end": le, "line_doc": doc, "line_failed": failed}


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_failed boolean, kept boolean, n_lost_words long"


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The counts and verdicts of each row: a row each, repeated rows included.

    A null or empty text has no words, so it fails the base rules; a null key stays null. Only the two columns named are
    read. An empty table gives no rows. Texts are worked on whole, about a megabyte at a time, a longer one alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                m = measure(*text_bytes(part.column("t")))
                columns = [part.column("k").cast(pa.int64()), *(pa.array(m[c], pa.int64()) for c in _COUNTS), pa.array(m["base_failed"]),
                    pa.array(m["kept"]), pa.array(m["n_lost_words"], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *_COUNTS, "base_failed", "kept", "n_lost_words"])

    bounded(docs.sparkSession)
    return docs.selectExpr(f"`{key}` AS k", f"`{text}` AS t").mapInArrow(trimmed(run), _SCHEMA)


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, all columns, their texts without the failed lines.

    A null or empty text has no words and goes; repeated rows are judged alike; null keys, and columns of any names, pass
    through. An empty table gives no rows.
    """
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.names[at]):
                data, offsets = text_bytes(part.column(at))
                m = measure(data, offsets)
                texts = part.column(at).to_pylist()
                raw, cut = data.tobytes(), np.flatnonzero(m["line_failed"])
                # failed lines are in the order of their documents
                first = np.searchsorted(m["line_doc"][cut], np.arange(len(part) + 1))
                for i in np.unique(m["line_doc"][cut]).tolist():
                    pieces, done = [], int(offsets[i])
                    for j in cut[first[i] : first[i + 1]].tolist():
                        pieces.append(raw[done : int(m["line_start"][j])])
                        done = min(int(m["line_end"][j]) + 1, int(offsets[i + 1]))
                    pieces.append(raw[done : int(offsets[i + 1])])
                    texts[i] = b"".join(pieces).decode()
                columns = [pa.array(texts, c.type) if k == at else c for k, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array(m["kept"]))

    bounded(docs.sparkSession)
    return map_rows(docs, run, docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))


_PHRASES = "|".join(BOILERPLATE)
OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS x FROM d)),
g AS (SELECT r, i, w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p AS g FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
tw AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM tw) GROUP BY r),
wc AS (SELECT r, count(*) AS n, sum(length(w)) AS c FROM w GROUP BY r),
l AS (SELECT r, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n, length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) AS s,
             length(regexp_replace(l, '[^|>]', '', 'g')) AS p, length(regexp_replace(l, '[^!]', '', 'g')) AS x
      FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)),
lf AS (SELECT r, l, n, (n >= {TITLE_WORDS} AND NOT regexp_matches(l, '[.!?:;"'')\]…”»][\x20\x09-\x0D]*$')) OR (s >= {SYMBOLS} AND 10 * s >= 3 * n)
              OR (p >= {SEPARATORS} AND 4 * p >= n) OR (x >= {SHOUTS} AND 2 * x >= n) OR regexp_matches(lower(l), '{_PHRASES}') AS f FROM l WHERE n > 0),
la AS (SELECT r, count(*) - count(DISTINCT l) AS dup, coalesce(sum(n) FILTER (f), 0) AS lost FROM lf GROUP BY r),
m AS (SELECT doc_id, t, coalesce(wc.n, 0) AS n_words, coalesce(wc.c, 0) AS word_chars, coalesce(dup, 0) AS n_dup_lines,
             coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
      FROM d LEFT JOIN wc USING (r) LEFT JOIN rep USING (r) LEFT JOIN la USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND lost <= {MAX_LOST} * n_words AS kept, lost::BIGINT AS n_lost_words
FROM b
"""
