"""Chunkers that follow structure: paragraphs, sections, tables, lists.

One greedy rule serves them all: units are packed in order up to a target, and a
unit that is too large by itself is handed to a finer splitter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ABBREVIATIONS

TARGET, MOST, OVERLAP = 384, 1024, 48
_TOKEN = re.compile(r"\w+|[^\w\s]")
_BREAK = re.compile(r"(?<=[.?!])\s+(?=[A-Z0-9\"'(\[])")
_ITEM = re.compile(r"^\s*(?:[-*•]|\d{1,4}[.)])\s+")


def size(text: str) -> int:
    return len(_TOKEN.findall(text))


def paragraphs(text: str) -> list[str]:
    return [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]


def sentences(text: str) -> list[str]:
    out: list[str] = []
    for part in filter(None, map(str.strip, _BREAK.split(text))):
        if out and (out[-1].split()[-1].lower() in ABBREVIATIONS or re.search(r"\b\d+\.$", out[-1])):
            out[-1] += f" {part}"
        else:
            out.append(part)
    return out


def word_windows(text: str, words: int, overlap: int) -> Iterator[str]:
    all_words, at = text.split(), 0
    while at < len(all_words):
        yield " ".join(all_words[at : at + words])
        if at + words >= len(all_words):
            return
        at += max(1, words - overlap)


def packed(units: list[str], target: int, sep: str, finer: Callable[[str], Iterator[str]] | None = None, over: int | None = None) -> Iterator[str]:
    """Runs of units of at most target tokens; a unit of more than `over` (the target) goes to finer."""
    held: list[str] = []
    n = 0
    for unit in units:
        t = size(unit)
        large = finer is not None and t > (target if over is None else over)
        if held and (large or n + t > target):
            yield sep.join(held)
            held, n = [], 0
        if large:
            yield from finer(unit)
        else:
            held.append(unit)
            n += t
    if held:
        yield sep.join(held)


def by_sentences(text: str, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> Iterator[str]:
    return packed(sentences(text), target, " ", lambda s: word_windows(s, target, overlap), most)


def recursive(text: str, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> list[str]:
    """The text whole if it fits; else its paragraphs packed, long ones by sentences, giant sentences by words."""
    text = text.strip()
    if not text or size(text) <= target:
        return [text] if text else []
    return list(packed(paragraphs(text), target, "\n\n", lambda p: by_sentences(p, target, most, overlap)))


def section(title_path: list[str], text: str, target: int = TARGET, most: int = MOST) -> list[str]:
    """A section whole, or packed, each piece under its breadcrumb."""
    head = f"[{' > '.join(title_path)}]\n" if title_path else ""
    whole = text.strip()
    pieces = [whole] if size(whole) <= most else list(packed(paragraphs(whole), target, "\n\n", lambda p: by_sentences(p, target, most)))
    return [head + p for p in pieces if p]


def table(lines: list[str], caption: str = "", target: int = TARGET, most: int = MOST) -> list[str]:
    """A pipe table whole, or rows packed under the repeated header as parts i of n."""
    head, rows = lines[:2], lines[2:]
    if len(rows) <= 1 or size("\n".join(lines)) <= most:
        return ["\n".join(([caption] if caption else []) + lines)]
    parts = list(packed(rows, max(1, target - size("\n".join(head))), "\n"))
    return ["\n".join([f"{caption} (Part {i} of {len(parts)})".strip(), *head, p]) for i, p in enumerate(parts, 1)]


def list_blocks(text: str) -> list[tuple[str, list[str]]]:
    """Runs of ("list", items) and ("prose", lines); an indented or short line after an item belongs to it."""
    out: list[tuple[str, list[str]]] = []
    for line in text.split("\n"):
        if not line.strip():
            continue
        if _ITEM.match(line):
            kind = "list"
        elif out and out[-1][0] == "list" and (line[0] in " \t" or len(line) < 80):
            out[-1][1][-1] += f"\n{line}"
            continue
        else:
            kind = "prose"
        if not out or out[-1][0] != kind:
            out.append((kind, []))
        out[-1][1].append(line)
    return out


def lists(text: str, target: int = TARGET, most: int = MOST) -> list[str]:
    out: list[str] = []
    for kind, parts in list_blocks(text):
        out += packed(parts, target, "\n") if kind == "list" else packed(["\n".join(parts)], target, "\n", lambda p: by_sentences(p, target, most))
    return out


def sections(text: str, target: int = TARGET, most: int = MOST) -> list[str]:
    """Each section of a Markdown text, packed under the titles that lead to it; what is before the first heading has none."""
    out: list[str] = []
    path: list[tuple[int, str]] = []
    held: list[str] = []
    for line in [*text.split("\n"), None]:
        heading = line is not None and re.match(r"^(#{1,6})\s+(.*)$", line.strip())
        if line is None or heading:
            out += section([t for _, t in path], "\n".join(held), target, most)
            held = []
        if heading:
            level = len(heading[1])
            path = [(n, t) for n, t in path if n < level] + [(level, heading[2])]
        elif line is not None:
            held.append(line)
    return out


def tables(text: str, target: int = TARGET, most: int = MOST) -> list[str]:
    """The pipe tables of a text, each whole or in parts under its header."""
    out: list[str] = []
    held: list[str] = []
    for line in [*text.split("\n"), ""]:
        if re.match(r"^\|.*\|$", line.strip()):
            held.append(line.strip())
        elif held:
            if len(held) >= 2:
                out += table(held, "", target, most)
            held = []
    return out


STRATEGIES: dict[str, Callable[[str], list[str]]] = {"recursive": recursive, "section": sections, "list": lists, "table": tables}


def register_strategy(name: str, split: Callable[[str], list[str]]) -> None:
    STRATEGIES[name] = split


#: Texts that a task holds as Python strings with their chunks at once.
TOGETHER = 256


def _cut(batches: Iterator[pa.RecordBatch], split, key: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, TOGETHER):
            b = whole.slice(lo, TOGETHER)
            rows = [(k, i, c) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, c in enumerate(split(t or ""))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.string()), strict=True)], names=[key, "chunk_index", "content"])


def chunks(docs: DataFrame, key: str, text: str, strategy: str = "recursive") -> DataFrame:
    """key, chunk_index, content of every row whose text is not blank, by a named strategy."""
    split = STRATEGIES[strategy]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cut(batches, split, key)

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, f"{key} long, chunk_index int, content string")
