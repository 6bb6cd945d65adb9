"""Quality rules: how much of a text lies in repeated n-grams and lines.

Words are runs of bytes other than space and \\t..\\r. Base figures come from
exact 3-word windows; the verdict is by repetition alone: rolling hashes in numpy
measure the characters inside n-grams of several lengths that came before, and
inside such lines. The limits are those published for these rules, of which the
usual programs, too, leave out a repeated n-gram's first place. Whether a text has
many symbols for its words is told beside the verdict and does not enter it;
README.md has what each rejects of labelled documents.

Defined results: a null or empty text has no words and fails; a document is
judged by itself, so repeated rows and ties give equal rows; further columns of
the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\v\f\r"
MIN_WORDS = 50
#: n-gram length: the largest share of word characters inside n-grams that came before in the text.
NGRAM_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_SHARE, LINE_CHAR_SHARE = 0.30, 0.20
#: Symbols for each word above which a text is told to have many.
SYMBOL_SHARE = 0.10
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, many_symbols boolean, n_lines long, dup_line_chars long, " + ", ".join(f"dup_{n}gram_chars long" for n in NGRAM_SHARE)


def covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in a window of n words that begins where starts is true."""
    edge = np.zeros(words + 1, np.int32)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated(keys: np.ndarray, first: bool) -> np.ndarray | None:
    """Which keys occur twice or more, the first of each included or not; None if none does."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return None
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    if first:
        out[order[:-1][same]] = True
    return out


def measure(text: str | None) -> tuple:
    """The figures of one text, in the order of SCHEMA after doc_id."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in BLANK)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    seen: set[str] = set()
    dup_lines = dup_line_chars = 0
    for x in lines:
        if x in seen:
            dup_lines += 1
            dup_line_chars += len(x)
        seen.add(x)

    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    repeat_words, grams = 0, dict.fromkeys(NGRAM_SHARE, 0)
    if n >= 3:
        v = len(index)
        if v < 2**21:
            triples = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
        else:
            triples = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)[1].ravel()
        if (dup := repeated(triples, True)) is not None:
            repeat_words = int(covered(dup, 3, n).sum())
            lengths = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), np.int64, n)
            codes = (ids.astype(np.uint64) + np.uint64(1)) * MIX
            codes ^= codes >> np.uint64(29)
            rolling = codes.copy()
            for size in range(2, max(NGRAM_SHARE) + 1):
                if n < size:
                    break
                rolling = rolling[: n - size + 1] * BASE + codes[size - 1 :]
                if size in grams:
                    if (dup := repeated(rolling, False)) is None:  # nor is a longer n-gram
                        break
                    grams[size] = int(lengths[covered(dup, size, n)].sum())
    line_chars = sum(map(len, lines))
    failed = n < MIN_WORDS or 100 * repeat_words > 50 * n
    kept = not failed and all(grams[k] <= share * word_chars for k, share in NGRAM_SHARE.items()) and dup_lines <= LINE_SHARE * len(lines) and dup_line_chars <= LINE_CHAR_SHARE * line_chars
    return (n, word_chars, symbols, dup_lines, repeat_words, failed, kept, symbols > SYMBOL_SHARE * n, len(lines), dup_line_chars, *grams.values())


def quality_rules(docs: DataFrame) -> DataFrame:
    """A row for each document with its figures and whether it is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t) for t in b.column(1).to_pylist()]
            columns = [pa.array(c) for c in zip(*rows, strict=True)] if rows else []
            if rows:
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=names)

    return pick(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def good(text: Column) -> Column:
    """Whether a text passes."""

    @F.pandas_udf("boolean")
    def passes(texts: pd.Series) -> pd.Series:
        return pd.Series([measure(t if isinstance(t, str) else None)[6] for t in texts], dtype=bool)

    return passes(text)
