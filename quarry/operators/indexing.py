"""Points into collections: validated, routed, compared with what is stored, and committed as one transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.transactions import Store
from . import metadata, vectors


def point_problems(dimension: int) -> Column:
    """Names of what is wrong with a point's vector or payload."""
    return F.concat(vectors.problems(F.col("vector"), dimension), metadata.payload_problems())


def stored_points(store: Store, collections: list[str] | None = None) -> DataFrame | None:
    """The points of some collections, or of all, as of the newest version; None if there are none."""
    held = store.manifest().get("collections", {})
    out = None
    for name, tx in held.items():
        if collections is None or name in collections:
            rows = store.spark.read.parquet(f"{store.path}/data/{tx}/points").where(F.col("collection") == name)
            out = rows if out is None else out.unionByName(rows)
    return out


def index_points(store: Store, points: DataFrame, dimension: int, complete: bool = False) -> dict[str, int]:
    """Takes points (chunk_id, vector, content and the payload that rules and routes look at); how many were new, modified, unchanged, deleted and rejected.

    Invalid points are staged with their problems and go no further. A point is
    modified if its vector, payload or collection differs. complete: points that are
    not there are deleted. Only collections with a change are written anew, and
    readers see all of the new version or none; of one chunk_id, the row with the
    smallest hash counts.
    """
    store.recover()
    now = store.manifest()
    tx = store.begin()
    told = points.withColumn("problems", point_problems(dimension))
    told = tx.stage(told, "incoming")
    bad = tx.stage(told.where(F.size("problems") > 0), "rejected")
    payload = [c for c in points.columns if c != "chunk_id"]
    mark = F.xxhash64(*payload)
    good = told.where(F.size("problems") == 0).drop("problems").withColumns({"mark": mark, "collection": vectors.route(F.col("standards"), F.col("category"), F.col("document_name"))})
    # hashes alone tell what counts and what changed; points travel only if they are written
    told = good.groupBy("chunk_id").agg(F.min(F.struct("mark", "collection")).alias("r")).select("chunk_id", "r.*")
    old = stored_points(store)
    if old is None:
        kinds = tx.stage(told.select("chunk_id", "collection", F.lit(None).cast("string").alias("was"), F.lit("new").alias("kind"), "mark"), "changes")
    else:
        before = old.select("chunk_id", F.col("mark").alias("_m"), F.col("collection").alias("was"))
        both = told.join(before, "chunk_id", "full_outer" if complete else "left")
        kind = F.when(F.col("was").isNull(), "new").when(F.col("mark").isNull(), "deleted").when((F.col("mark") == F.col("_m")) & (F.col("collection") == F.col("was")), "unchanged").otherwise("modified")
        kinds = tx.stage(both.select("chunk_id", "collection", "was", kind.alias("kind"), "mark"), "changes")
    counts = dict(kinds.groupBy("kind").count().collect()) | {"rejected": bad.count()}
    changed = kinds.where("kind <> 'unchanged'")
    touched = [r["c"] for r in changed.select(F.explode(F.array("collection", "was")).alias("c")).where("c IS NOT NULL").distinct().collect()]  # collections, as many as routes
    left = set()
    if touched:
        fresh = good.join(changed.where("kind <> 'deleted'").select("chunk_id", "mark"), ["chunk_id", "mark"], "left_semi").dropDuplicates(["chunk_id", "mark"])
        kept = stored_points(store, touched)
        rows = fresh if kept is None else kept.join(changed.select("chunk_id"), "chunk_id", "left_anti").unionByName(fresh.select(kept.columns))
        left = {r["collection"] for r in tx.stage(rows, "points", ["collection"]).select("collection").distinct().collect()}
    collections = {c: t for c, t in now.get("collections", {}).items() if c not in touched} | {c: tx.tx for c in left}
    tx.commit({"collections": collections, "transactions": sorted(set(collections.values()))})
    return counts
