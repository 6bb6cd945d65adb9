"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in hash order, form blocks. Sources advance at rates in
proportion to their integer weights; a source that runs out leaves its share to
the rest in proportion. Block j of a source is released when that fluid schedule
starts it, and due when it ends it, in whole slots. Earliest deadline first then
gives every block a slot of its own inside its window, so at any slot a source
is less than one block away from its target.

After each round, in which a source of weight w gets w blocks, every target is a
whole number and no window reaches across, so rounds are scheduled apart. Rounds
differ only where a source ends: at most 2 * sources + 1 kinds, each of at most
sum(weights) slots, are worked out on the driver, whatever the corpus.

Sources without a weight of their own, null among them, form one pool, so the
number of streams is bounded by the parameter. Every row appears once.

Defined results: a null doc_id or text is a value like any other, and its row has a
place; a text of any length is one row, or as much as its size column says; equal
rows take places of their own, either way round; further columns are ignored or
carried; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked

BLOCK = 64
POOL = "*"
#: The columns that mix adds.
ADDED = ("mix_stream", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place")


def windows(weights: list[int], left: list[int]) -> list[tuple[int, int, int, int]]:
    """(release, deadline, stream, block) of a round in which stream i has left[i] <= weights[i] blocks."""
    out = []
    for i, (w, c) in enumerate(zip(weights, left, strict=True)):
        reach = [sum(min(d * w, v * j) for v, d in zip(weights, left, strict=True)) for j in range(c + 1)]  # w times the slot
        out += [(reach[j] // w, -(-reach[j + 1] // w), i, j) for j in range(c)]
    return out


def earliest_deadline_first(jobs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Gives each job (release, deadline, stream, block) a slot of its own within its window."""
    waiting, ready, out, slot = sorted(jobs), [], [], 0
    at = 0
    while at < len(waiting) or ready:
        while at < len(waiting) and waiting[at][0] <= slot:
            release, deadline, stream, block = waiting[at]
            heapq.heappush(ready, (deadline, release, stream, block))
            at += 1
        deadline, release, stream, block = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a window was missed")
        out.append((release, deadline, stream, block, slot))
        slot += 1
    return out


def schedule(weights: list[int], blocks: list[int]) -> tuple[list[int], list[tuple[int, int, int, int, int, int]]]:
    """First round of each kind, and (kind, stream, block, release, deadline, slot) within a round of the kind."""
    starts = sorted({0, *(r for w, n in zip(weights, blocks, strict=True) for r in (n // w, n // w + 1))})
    rows = []
    for kind, r in enumerate(starts):
        left = [max(0, min(w, n - w * r)) for w, n in zip(weights, blocks, strict=True)]
        rows += [(kind, s, b, a, z, slot) for a, z, s, b, slot in earliest_deadline_first(windows(weights, left))]
    return starts, rows


def mix(docs: DataFrame, weights: dict[str, int], default: int = 1, block: int = BLOCK, carry: bool = False, size: str | None = None) -> DataFrame:
    """Adds mix_stream, mix_block, mix_release, mix_deadline, mix_slot (slots of whole blocks) and mix_place (in the block).

    weights: positive whole numbers; default: that of the pool. carry: keeps all
    columns of docs; otherwise doc_id and source alone. Blocks have `block`
    documents or, where size names a column, as much of it: a document is of the
    block in which it begins, and slots that one covers whole have no other. A
    size that is null or below one counts as one.
    """
    if min([default, *weights.values()]) < 1:
        raise ValueError("weights are positive whole numbers")
    spark = docs.sparkSession
    streams = [*sorted(weights), POOL]
    w = [*(weights[s] for s in streams[:-1]), default]
    if carry:
        names = docs.columns
        place = {}
        for i, c in enumerate(names):
            place.setdefault(c, i)
        flat = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    else:
        names = ["doc_id", "source"]
        place = {c: docs.columns.index(c) for c in names}
        flat = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    source, doc_id = f"_c{place['source']}", f"_c{place['doc_id']}"
    kept = [f"_c{i}" for i in range(len(names))] if carry else [doc_id, source]
    number: Column = F.lit(len(streams) - 1)
    for i, s in enumerate(streams[:-1]):
        number = F.when(flat[source] == s, i).otherwise(number)
    measured = F.greatest(flat[f"_c{docs.columns.index(size)}"].cast("long"), F.lit(1)) if size else F.lit(1)
    flat = flat.select(*kept, number.alias("_stream"), F.coalesce(measured, F.lit(1)).cast("long").alias("_size"))
    order = [c for c in kept if c == doc_id] + [c for c in kept if c != doc_id]
    rows = ranked(flat, ["_stream"], order, "_rank", weight="_size" if size else None)

    counts = {s: n for s, n in flat.groupBy("_stream").agg(F.sum("_size")).collect()}  # a row for each stream at most
    blocks = [-(-counts.get(i, 0) // block) for i in range(len(streams))]
    starts, table = schedule(w, blocks)
    plan = spark.createDataFrame(table or [(-1, 0, 0, 0, 0, 0)], "_kind int, _s int, _j long, _release long, _deadline long, _slot long")

    weight = F.element_at(F.array(*[F.lit(x) for x in w]), F.col("_stream") + 1)
    rows = rows.withColumn("_block", F.floor(F.col("_rank") / block)).withColumn("_round", F.floor(F.col("_block") / weight)).withColumn("_local", F.col("_block") - F.col("_round") * weight)
    rows = rows.withColumn("_at", F.size(F.filter(F.array(*[F.lit(int(x)) for x in starts]), lambda x: x <= F.col("_round"))) - 1)
    begun = sum((F.least(F.lit(n), F.col("_round") * v) for n, v in zip(blocks, w, strict=True)), F.lit(0).cast("long"))
    joined = rows.join(F.broadcast(plan), (F.col("_at") == F.col("_kind")) & (F.col("_stream") == F.col("_s")) & (F.col("_local") == F.col("_j")))
    label = F.element_at(F.array(*[F.lit(s) for s in streams]), F.col("_stream") + 1)
    added = [label, F.col("_block"), begun + F.col("_release"), begun + F.col("_deadline"), begun + F.col("_slot"), F.col("_rank") % block]
    return joined.select(*kept, *[c.alias(f"_added{i}") for i, c in enumerate(added)]).toDF(*names, *ADDED)
