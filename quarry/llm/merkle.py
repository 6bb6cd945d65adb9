"""Merkle manifest of a table: a tree for each source, and one over the sources' roots.

Superblock reduction: a node's index is cut by FANOUT ** LEVELS into superblocks,
a task collapses LEVELS levels of one at a time, and the superblocks' roots are
reduced again until one is left, in rounds that grow with the logarithm of the
table. Proofs go the other way: the upper path of a superblock, a row for 4096
leaves, meets its leaves once more, and each leaf's lower path is put before it.
Only digests travel, and no task holds more than a superblock.

H is the lower-case hexadecimal sha256 of its inputs' concatenation, digests as
hexadecimal text; between tasks they are 32 bytes. Indices come from a sort by
ranges (source, doc_id, leaf), the rows that each range holds of each source,
and sums over the ranges before.

Defined results: a null column is written `-`, so null and empty texts differ; a
null source is a source, and first; a null doc_id comes first and is never
tampered with; rows with one doc_id are ordered by their leaves, and equal rows
take neighbouring places; further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import pick, remove_path, shared_path, shuffle_width

FANOUT, LEVELS = 16, 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PROOF = "doc_id long, source string, leaf string, subroot string, proof_sha256 string, folded_root string, path binary"


def h(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above n nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def tower(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes, and so many levels above them."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([h(*below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return out


def path_of(levels: list[list[str]], i: int) -> bytes:
    """For each level but the last: the place in the run, the run's length, and the siblings' digests."""
    out = []
    for nodes in levels[:-1]:
        first = i - i % FANOUT
        run = nodes[first : first + FANOUT]
        del run[i - first]
        out.append(bytes((i - first, len(run) + 1)) + bytes.fromhex("".join(run)))
        i //= FANOUT
    return b"".join(out)


def steps(path: bytes) -> Iterator[tuple[int, list[str]]]:
    """(place, siblings) of each level of a path."""
    at = 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        text = path[at + 2 : at + 2 + 32 * (n - 1)].hex()
        yield place, [text[i : i + 64] for i in range(0, len(text), 64)]
        at += 2 + 32 * (n - 1)


def fold(leaf: str, path: bytes) -> str:
    """The root that a leaf and its siblings give."""
    for place, siblings in steps(path):
        leaf = h(*siblings[:place], leaf, *siblings[place:])
    return leaf


def proof_digest(path: bytes) -> str:
    return h(*(s for _, siblings in steps(path) for s in siblings))


def leaf_digest(text: Column) -> Column:
    """H of a row's columns, `text` in place of its text."""
    told = [F.col(c).cast("string") if c != "text" else text for c in COLUMNS]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in told]), 256))


def tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def indexed(df: DataFrame, group: str, order: list[str], store) -> DataFrame:
    """Adds idx, the place of each row in its group, and n, the group's rows. A group may hold any share of all rows."""
    width = shuffle_width(df.sparkSession)
    placed = store(df.repartitionByRange(width, group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    runs = placed.groupBy(F.col(group).alias("_g"), part.alias("_p")).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    whole = W.partitionBy("_g")
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = store(runs.select("_g", "_p", "_first", before.alias("_before"), F.sum("_rows").over(whole).alias("n")), "runs")
    met = placed.join(runs, (F.col(group) == F.col("_g")) & (part == F.col("_p")))
    return met.withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_g", "_p", "_first", "_before")


def _sorted(table: pa.Table) -> pa.Table:
    return table.take(np.argsort(table["idx"].to_numpy(), kind="stable"))


def superblock(levels: int) -> Column:
    return F.expr(f"idx div {FANOUT**levels}").alias("sb")


def collapse(nodes: DataFrame, levels: int) -> DataFrame:
    """(grp, idx, n, node) of the superblocks' roots."""
    size = FANOUT**levels

    def top(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        n = table["n"][0].as_py()
        root = tower([x.hex() for x in table["node"].to_pylist()], min(levels, depth(n)))[-1][0]
        return pa.table({"grp": table["grp"].slice(0, 1), "idx": pa.array([table["idx"][0].as_py() // size], pa.int64()), "n": pa.array([-(-n // size)], pa.int64()), "node": pa.array([bytes.fromhex(root)], pa.binary())})

    dealt = nodes.select("grp", "idx", "n", "node", superblock(levels))
    return dealt.groupBy("grp", "sb").applyInArrow(top, "grp string, idx long, n long, node binary")


def reduced(nodes: DataFrame, levels: int, store) -> list[DataFrame]:
    """The nodes, and the roots of their superblocks, and so on, until each group has one node."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 1) > 1:
        out.append(store(collapse(out[-1], levels), "nodes"))
    return out


def paths(rounds: list[DataFrame], top: DataFrame, levels: int, store) -> DataFrame:
    """(grp, idx, node, path) of the first round's nodes; top has the path (grp, upper, subroot) from each group's root on."""

    def lower(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = _sorted(nodes)
        upper, subroot = above["upper"][0].as_py(), above["subroot"].slice(0, 1).to_pylist() * len(nodes)
        tree = tower([x.hex() for x in nodes["node"].to_pylist()], min(levels, depth(nodes["n"][0].as_py())))
        path = [path_of(tree, i) + upper for i in range(len(nodes))]
        return pa.table({"grp": nodes["grp"], "idx": nodes["idx"], "upper": pa.array(path, pa.binary()), "subroot": pa.array(subroot, pa.binary())})

    above = top.select("grp", F.lit(0).cast("long").alias("idx"), "upper", "subroot")
    for nodes in rounds[-2::-1]:
        dealt = nodes.select("grp", "idx", "n", "node", superblock(levels))
        above = store(dealt.groupBy("grp", "sb").cogroup(above.groupBy("grp", "idx")).applyInArrow(lower, "grp string, idx long, upper binary, subroot binary"), "paths")
    return above


def manifest(docs: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, str | None]:
    """doc_id, source, leaf, subroot, proof_sha256, folded_root and the path itself, for each row; and the root, None of an empty table.

    path holds, for each level from the leaf on, the leaf's place in its run, the
    run's length and the others' digests; fold() gives the root again.
    """
    spark = docs.sparkSession
    made = []

    def store(df: DataFrame, name: str) -> DataFrame:
        made.append(path := shared_path(spark, f"merkle-{name}"))
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    rows = pick(docs, *COLUMNS)
    told = F.when(tampered(F.col("doc_id")) & F.col("text").isNotNull(), leaf_digest(F.translate("text", UPPER, LOWER)))
    leaves = rows.select("doc_id", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("grp"), leaf_digest(F.col("text")).alias("node"), told.alias("told"))
    # written first, so that drawing the ranges does not hash every text once more
    leaves = store(indexed(store(leaves, "digests"), "grp", ["doc_id", "node"], store), "leaves")
    rounds = reduced(store(collapse(leaves, levels), "nodes"), levels, store)

    # the last round has each source's root, at index 0
    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("grp").alias("of"), "node")
    sources = store(indexed(subroots, "tree", ["of"], store).withColumnRenamed("tree", "grp"), "sources")
    over = reduced(sources, levels, store)
    root = over[-1].first()
    upper = paths(over, over[-1].select("grp", F.lit(b"").alias("upper"), F.col("node").alias("subroot")), levels, store)
    top = store(sources.join(upper.select("idx", "upper"), "idx").select(F.col("of").alias("grp"), "upper", F.col("node").alias("subroot")), "tops")
    above = paths(rounds, top, levels, store)

    def prove(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = _sorted(nodes)
        upper, subroot = above["upper"][0].as_py(), above["subroot"][0].as_py().hex()
        leaf = [x.hex() for x in nodes["node"].to_pylist()]
        tree = tower(leaf, min(levels, depth(nodes["n"][0].as_py())))
        path = [path_of(tree, i) + upper for i in range(len(leaf))]
        folded = [fold(t.hex() if t else x, p) for x, t, p in zip(leaf, nodes["told"].to_pylist(), path, strict=True)]
        grp = nodes["grp"][0].as_py()
        columns = (nodes["doc_id"], [grp[1:] if grp else None] * len(leaf), leaf, [subroot] * len(leaf), [proof_digest(p) for p in path], folded, path)
        return pa.table([pa.array(c, t) if isinstance(c, list) else c for c, t in zip(columns, (pa.int64(), *[pa.string()] * 5, pa.binary()), strict=True)], names=[x.split()[0] for x in PROOF.split(", ")])

    proved = leaves.select("*", superblock(levels)).groupBy("grp", "sb").cogroup(above.groupBy("grp", "idx")).applyInArrow(prove, PROOF)
    for path in made:
        if not any(part in path for part in ("merkle-leaves", "merkle-paths", "merkle-tops")):
            remove_path(spark, path)
    return proved, root["node"].hex() if root else None


def proofs(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """manifest() with the root in each row, and whether the folded root equals it."""
    found, root = manifest(docs, levels)
    return found.withColumns({"root": F.lit(root).cast("string"), "verified": F.col("folded_root") == F.lit(root).cast("string")})
