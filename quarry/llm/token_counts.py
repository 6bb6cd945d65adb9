"""Edit-aware token counts: a segment tree of pre-token counts for each document.

Leaves hold runs of pre-tokens with their lengths in characters and tokens; the
inner nodes hold sums. An edit finds its leaves by descent, takes back the text
from a boundary that it cannot reach, splits and counts that region until old
and new boundaries meet again, replaces the leaves, and updates the sums above.

Why boundaries are safe: the pre-tokeniser's pattern reads left to right and
looks at most two characters, or an added token, past a pre-token, so one that
ends further before an edit is not touched; and once a boundary behind the edit
coincides with an old one, the rest of the split repeats.

Defined results: a null or empty text has no tokens; an edit beyond the end is
cut to the text; edits apply one after another; an emptied text has no tokens and
takes further edits; a text is handled by itself, so
repeated rows and ties give equal rows; further columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick
from .tokens import WS, added_tokens, counts, vocabulary_path

LEAF = 32
#: Pre-tokens whose counts a worker remembers before it starts anew.
REMEMBER = 800_000

_known: dict[str, int] = {}


@functools.cache
def pretokens(path: str) -> tuple[regex.Pattern, int]:
    """The pre-tokeniser's pattern, in which the strings of added tokens are units and end what is before them, and how far it looks ahead."""
    added = sorted(added_tokens(path), key=len, reverse=True)
    if any(regex.match(r"[\s\p{L}\p{N}']", a) for a in added):
        raise ValueError("added tokens begin with a letter, digit, quote or blank")
    special = "|".join(map(regex.escape, added)) or "(?!)"
    # Fixed value: the pre-tokeniser pattern of the byte-level vocabulary, with added tokens.
    pattern = rf"{special}|'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?(?:(?!{special})[^{WS}\p{{L}}\p{{N}}])+|[{WS}]+(?={special})|[{WS}]+(?![^{WS}])|[{WS}]+"
    return regex.compile(pattern), 2 + max(map(len, added), default=0)


def count_pretokens(parts: list[str], path: str) -> list[int]:
    fresh = list(set(parts).difference(_known))
    if len(_known) + len(fresh) > REMEMBER:
        _known.clear()
        fresh = list(set(parts))
    _known.update(zip(fresh, counts(fresh, path), strict=True))
    return [_known[p] for p in parts]


class CountTree:
    """Token count of a text that is being edited."""

    def __init__(self, text: str, path: str) -> None:
        self.text, self.path = text, path
        self.pattern, self.reach = pretokens(path)
        self.encoded = 0  # characters counted so far
        self._build(*self._split(text))

    def _split(self, text: str) -> tuple[list[int], list[int]]:
        parts = self.pattern.findall(text)
        self.encoded += len(text)
        return [len(p) for p in parts], count_pretokens(parts, self.path)

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self.leaves = [(chars[i : i + LEAF], tokens[i : i + LEAF]) for i in range(0, len(chars), LEAF)] or [([], [])]
        self.base = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.base, np.int64), np.zeros(2 * self.base, np.int64)
        for i, (c, t) in enumerate(self.leaves):
            self.chars[self.base + i], self.tokens[self.base + i] = sum(c), sum(t)
        n = self.base
        while n > 1:
            for x in (self.chars, self.tokens):
                x[n // 2 : n] = x[n : 2 * n].reshape(-1, 2).sum(1)
            n //= 2

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds character `place`, or the last one with text, and where it begins."""
        node, start = 1, 0
        place = min(place, max(0, int(self.chars[1]) - 1))
        while node < self.base:
            node *= 2
            if place - start >= self.chars[node]:
                start += int(self.chars[node])
                node += 1
        return node - self.base, start

    def _set(self, leaf: int, chars: list[int], tokens: list[int]) -> None:
        self.leaves[leaf] = (chars, tokens)
        node = self.base + leaf
        more = sum(chars) - int(self.chars[node]), sum(tokens) - int(self.tokens[node])
        while node:
            self.chars[node] += more[0]
            self.tokens[node] += more[1]
            node //= 2

    def edit(self, start: int, end: int, new: str) -> int:
        """Replaces text[start:end]; the new total."""
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        shift = len(new) - (end - start)
        first, at = self._leaf_at(max(0, start - self.reach))
        chars, tokens = self.leaves[first]
        kept = 0  # pre-tokens of the first leaf that the edit cannot reach
        where = at
        while kept < len(chars) and where + chars[kept] + self.reach <= start:
            where += chars[kept]
            kept += 1
        if kept == len(chars) and kept:  # the split before may end differently if more follows
            kept -= 1
            where -= chars[kept]
        text = self.text[:start] + new + self.text[end:]
        last, begins = self._leaf_at(end)
        old, edge = set(), begins
        for c in self.leaves[last][0]:
            old.add(edge + shift)
            edge += c
        stop = edge + shift
        made_c, made_t, parts, place = [], [], [], where
        met = None
        while met is None:
            for m in self.pattern.finditer(text, place):
                if m.start() >= start + len(new) and (m.start() in old or m.start() == stop):
                    met = m.start()
                    break
                if m.start() > stop:
                    break
                parts.append(m[0])
                place = m.end()
            else:
                met = len(text)
            if met is None:  # boundaries have not met within this leaf: take in the next
                last += 1
                while last < len(self.leaves) and not self.leaves[last][0]:
                    last += 1
                if last >= len(self.leaves):
                    stop = len(text)
                    continue
                begins = edge
                for c in self.leaves[last][0]:
                    old.add(edge + shift)
                    edge += c
                stop = edge + shift
        self.encoded += sum(map(len, parts))
        made_c, made_t = [len(p) for p in parts], count_pretokens(parts, self.path)
        tail, edge = 0, begins
        lc, lt = self.leaves[last] if last < len(self.leaves) else ([], [])
        while tail < len(lc) and edge + shift < met:
            edge += lc[tail]
            tail += 1
        if met == len(text):  # the split ran to the end, over all leaves behind
            last, tail = len(self.leaves) - 1, len(lc)
        new_c, new_t = chars[:kept] + made_c + lc[tail:], tokens[:kept] + made_t + lt[tail:]
        self.text = text
        for leaf in range(first + 1, min(last + 1, len(self.leaves))):
            self._set(leaf, [], [])
        self._set(first, new_c, new_t)
        if not text:
            self._build([], [])  # a descent needs a leaf with text, or a single one
        elif len(new_c) > 8 * LEAF:
            self._build([c for x, _ in self.leaves for c in x], [t for _, y in self.leaves for t in y])
        return self.total


COUNTS = "doc_id long, n_tokens long, n_tokens_edited long, n_chars long, n_chars_edited long, chars_reencoded long"


def edited_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Counts before and after the edits of each row.

    docs has doc_id, text and edits, an array of structs (start, end, new) in the
    order in which they apply, each in code points of the text as it then is.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in COUNTS.split(", ")]
        for b in batches:
            rows = []
            for t, edits in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                tree = CountTree(t or "", path)
                before, n, encoded = tree.total, len(tree.text), tree.encoded
                for e in edits or []:
                    tree.edit(e["start"] or 0, e["end"] or 0, e["new"] or "")
                rows.append((before, tree.total, n, len(tree.text), tree.encoded - encoded))
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]], names=names)

    return pick(docs, "doc_id", "text", "edits").mapInArrow(run, COUNTS)


def with_revision(docs: DataFrame) -> DataFrame:
    """A revision of each text: an insertion at a third, a replacement from two thirds, a deletion at the end."""
    n = F.length(F.coalesce("text", F.lit("")))
    edit = lambda a, z, s: F.struct(a.cast("long").alias("start"), z.cast("long").alias("end"), F.lit(s).alias("new"))
    return pick(docs, "doc_id", "text").withColumn("edits", F.array(edit(F.floor(n / 3), F.floor(n / 3), " (see note 12) "), edit(F.floor(2 * n / 3), F.floor(2 * n / 3) + 24, "revised, it's 2.0"), edit(F.greatest(n - 10, F.lit(0)), n + 64, "")))
