"""Vectors: validation, nearest neighbours, filters, differences, routing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lexical import top_k

#: Bytes of query vectors that are sent whole to all tasks.
QUERY_BLOCK = 32 << 20
#: Rows of a part; lists at most; bytes of the sample that centroids are fitted on, and its rows that serve as queries to choose the number of lists sought.
PART, LISTS, SAMPLE_BYTES, TRIALS = 4096, 4096, 32 << 20, 512
#: Share of true neighbours that the lists sought shall hold, with a margin for what the sample cannot tell.
RECALL, MARGIN = 0.95, 0.02
#: Queries whose scores with PART rows are held at once.
QUERIES = 1024


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def problems(v: Column, dimension: int, tolerance: float = 0.02) -> Column:
    """Names of what is wrong with a vector, in order; empty if it is valid."""
    size = F.coalesce(F.size(v), F.lit(0))
    return F.array_compact(
        F.array(
            F.when(v.isNull() | (size == 0), "empty"),
            F.when((size > 0) & (size != dimension), "dimension"),
            F.when(F.exists(v, lambda x: F.isnan(x)), "nan"),
            F.when(F.exists(v, lambda x: F.abs(x) == float("inf")), "infinite"),
            F.when((size > 0) & (F.abs(norm(v) - 1) > tolerance), "norm"),
        )
    )


def _unit(m: np.ndarray, metric: str) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) if metric == "cosine" else m


def _likeness(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Scores of each query with each row; both are unit vectors for the cosine."""
    if metric == "euclid":
        return -np.sqrt(np.maximum((rows * rows).sum(1)[None] + (queries * queries).sum(1)[:, None] - 2 * queries @ rows.T, 0))
    return queries @ rows.T


class _Found:
    """The k best (key, score) of each query, by place, as batches of scores come in."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]  # query, key, score

    def take(self, keys: np.ndarray, score: np.ndarray) -> None:
        # all that reach the k-th best score, ties included; what is more than k goes when the lists are cut
        least = np.partition(score, -self.k, axis=1)[:, -self.k] if score.shape[1] > self.k else np.full(self.n, -np.inf)
        q, c = np.nonzero((score >= least[:, None]) & (score > -np.inf))
        self.held.append((q, keys[c], score[q, c]))
        if sum(len(x[0]) for x in self.held) > 8 * self.k * self.n:
            self.held = [self.cut()]

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each query, ties by key."""
        q, c, v = map(np.concatenate, zip(*self.held, strict=True))
        order = np.lexsort((c, -v, q))
        q, c, v = q[order], c[order], v[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q, "left") < self.k
        return q[keep], c[keep], v[keep]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False))


def _labelled(score: np.ndarray, own: list, other: list) -> np.ndarray:
    """Scores of pairs whose labels differ are put out of reach."""
    names = {x: i for i, x in enumerate(sorted(set(own), key=repr))}
    return np.where(np.array([names[x] for x in own])[:, None] == np.array([names.get(x, -1) for x in other])[None, :], score, -np.inf)


def _scan(batches: Iterator[pa.RecordBatch], ids: np.ndarray, matrix: np.ndarray, labels: list | None, key: str, k: int, metric: str, digits: int | None) -> Iterator[pa.RecordBatch]:
    """query_id, key, score: the k best of these batches for each query, by blocks of QUERIES queries and PART rows, so that memory does not follow their product."""
    starts = range(0, len(ids), QUERIES)
    found = [_Found(len(ids[lo : lo + QUERIES]), k) for lo in starts]
    for whole in batches:
        for at in range(0, whole.num_rows, PART):
            b = whole.slice(at, PART)
            held, keys = _unit(_matrix(b.column(1)), metric), b.column(0).to_numpy()
            for lo, f in zip(starts, found, strict=True):
                score = _likeness(matrix[lo : lo + QUERIES], held, metric)
                if labels is not None:
                    score = _labelled(score, labels[lo : lo + QUERIES], b.column(2).to_pylist())
                f.take(keys, np.round(score, digits) if digits is not None else score)
    for lo, f in zip(starts, found, strict=True):
        q, c, v = f.cut()
        yield pa.RecordBatch.from_arrays([pa.array(ids[lo + q]), pa.array(c), pa.array(v)], names=["query_id", key, "score"])


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, metric: str = "cosine", same: str | None = None, digits: int | None = None) -> DataFrame:
    """query_id, key, score, rank (from 0) of the k nearest rows to each query row, itself among them; ties by key, on scores rounded to `digits` if given.

    Queries of up to QUERY_BLOCK bytes, counted first, go out whole; a task
    multiplies its batches with them and keeps k candidates a query. More are
    dealt out to the rows' parts by a shuffle, and none passes through the driver.
    same: a column that must agree.
    """
    schema = f"query_id long, {key} long, score double"
    extra = [same] if same else []
    # null-free vectors only; a broken row can be found with problems()
    rows = vectors.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"), *extra)
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("v"), *extra)
    if (asked.agg(F.sum(8 * F.size("v"))).first()[0] or 0) > QUERY_BLOCK:
        parts = max(1, -(-rows.count() // PART))
        dealt = rows.withColumns({"list": F.lit(0), "part": F.pmod(F.xxhash64(key), F.lit(parts))})
        met = asked.withColumns({"list": F.lit(0), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
        return top_k(_met(dealt, met, key, k, metric, same, digits), "query_id", "score", key, k)
    given = asked.collect()  # QUERY_BLOCK bytes at most
    if not given:
        return vectors.sparkSession.createDataFrame([], schema + ", rank int")
    ids, matrix, labels = np.array([r["query_id"] for r in given], np.int64), _unit(np.array([r["v"] for r in given]), metric), [r[same] for r in given] if same else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scan(batches, ids, matrix, labels, key, k, metric, digits)

    return top_k(rows.mapInArrow(run, schema), "query_id", "score", key, k)


def _met(rows: DataFrame, asked: DataFrame, key: str, k: int, metric: str, same: str | None, digits: int | None) -> DataFrame:
    """query_id, key, score: the k best of each part for the queries that are dealt to it, by (list, part)."""

    def run(own: pa.Table, other: pa.Table) -> pa.Table:
        if not len(own) or not len(other):
            return pa.table({"query_id": pa.array([], pa.int64()), key: pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        matrix, ids = _unit(_matrix(own["v"].combine_chunks()), metric), own["query_id"].to_numpy()
        keys, held = other[key].to_numpy(), _unit(_matrix(other["v"].combine_chunks()), metric)
        out = []
        for lo in range(0, len(ids), PART):  # a block of scores is PART squared at most
            score = _likeness(matrix[lo : lo + PART], held, metric)
            if same:
                score = _labelled(score, own[same].to_pylist()[lo : lo + PART], other[same].to_pylist())
            found = _Found(len(score), k)
            found.take(keys, np.round(score, digits) if digits is not None else score)
            q, c, v = found.cut()
            out.append((ids[lo + q], c, v))
        q, c, v = map(np.concatenate, zip(*out, strict=True))
        return pa.table({"query_id": q, key: c, "score": v})

    return asked.groupBy("list", "part").cogroup(rows.groupBy("list", "part")).applyInArrow(run, f"query_id long, {key} long, score double")


def centroids(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit vectors: spread first ones, then as many rounds of Lloyd's."""
    rng = np.random.default_rng(0)
    lists = min(lists, len(sample))
    chosen, far = [int(rng.integers(len(sample)))], np.full(len(sample), np.inf)
    while len(chosen) < lists:
        far = np.minimum(far, np.maximum(1 - sample @ sample[chosen[-1]], 0))
        chosen.append(int(rng.choice(len(sample), p=far / far.sum())) if far.sum() > 0 else int(rng.integers(len(sample))))
    middle = sample[chosen]
    for _ in range(rounds):
        near = (sample @ middle.T).argmax(1)
        total = np.zeros_like(middle)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        middle = np.where(size > 0, total / np.maximum(size, 1e-300), middle)
    return middle


def probes_for(sample: np.ndarray, middle: np.ndarray, k: int = 10) -> int:
    """How many lists hold RECALL of the k nearest of the sample's first rows among the sample.

    All rows lie closer to a query than the sample's alone, so in fewer lists.
    """
    near, asked = (sample @ middle.T).argmax(1), sample[:TRIALS]
    place = np.argsort(np.argsort(-(asked @ middle.T), axis=1, kind="stable"), axis=1)
    needed = []
    for i, q in enumerate(asked):
        best = np.argpartition(-(sample @ q), min(k, len(sample)) - 1)[:k]
        needed.append(place[i, near[best]])
    needed = np.sort(np.concatenate(needed))
    return int(needed[min(len(needed) - 1, int(np.ceil((RECALL + MARGIN) * len(needed))))]) + 1


def with_lists(rows: DataFrame, vector: str, middle: np.ndarray, n: int) -> DataFrame:
    """Adds `lists`, the n nearest centroids of each row's vector; rows without one are left out."""

    def nearest_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                score = _unit(_matrix(b.column("_v")), "cosine") @ middle.T
                best = np.argsort(-score, axis=1, kind="stable")[:, :n].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(best) + 1, dtype=np.int32) * best.shape[1]), pa.array(best.ravel()))
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns - 1)], lists], names=[*b.schema.names[:-1], "lists"])

    told = rows.where(F.col(vector).isNotNull()).withColumn("_v", F.col(vector).cast("array<double>"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return told.mapInArrow(nearest_lists, f"{kept}, lists array<int>")


def build_lists(vectors: DataFrame, key: str, vector: str, path: str, lists: int | None = None, sample_bytes: int = SAMPLE_BYTES) -> None:
    """Inverted lists of unit vectors under path: every row is in the list of its nearest centroid.

    Centroids, as many as the square root of the rows and LISTS at most, are
    fitted on a sample of at most sample_bytes, the rows whose keys have the
    smallest hashes; the same sample says how many lists a search has to look in.
    A list is cut into parts of about PART rows by a hash of the key, so a list may
    hold most of the rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    first = rows.select("v").first()
    n = rows.count()
    many = max(1, sample_bytes // (8 * len(first["v"]))) if first else 0
    sample = rows.orderBy(F.xxhash64("key"), "key").limit(many).select("v").collect() if first else []
    fitted = _unit(np.array([r["v"] for r in sample]), "cosine") if first else np.empty((0, 0))
    middle = centroids(fitted, lists or min(LISTS, max(1, round(n**0.5)))) if first else fitted
    spark.createDataFrame([(probes_for(fitted, middle) if first else 0,)], "probes int").write.parquet(f"{path}/settings")
    spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(middle)], "list int, v array<double>").write.parquet(f"{path}/centroids")
    told = with_lists(rows, "v", middle, 1).select("key", "v", F.col("lists")[0].alias("list")) if first else rows.withColumn("list", F.lit(0)).limit(0)
    told.write.parquet(f"{path}/listed")
    told = spark.read.schema(told.schema).parquet(f"{path}/listed")
    sizes = told.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    sizes.write.parquet(f"{path}/sizes")
    parts = F.broadcast(spark.read.schema(sizes.schema).parquet(f"{path}/sizes"))  # LISTS rows at most
    dealt = told.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).drop("parts")
    dealt.repartition("list", "part").sortWithinPartitions("list", "part").write.parquet(f"{path}/lists")


def search_lists(spark: SparkSession, path: str, queries: DataFrame, key: str, vector: str, k: int = 10, probes: int | None = None, exact: bool = False, digits: int | None = None) -> DataFrame:
    """query_id, key, score, rank of the k rows nearest by cosine in the `probes` lists nearest to each query, as many as the index says by itself, or in all of them; ties by key.

    Queries are a table that meets the lists by a shuffle; none passes through the driver.
    """
    middle = np.array([r["v"] for r in spark.read.parquet(f"{path}/centroids").orderBy("list").collect()])  # LISTS at most
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    if not len(middle):
        return spark.createDataFrame([], f"query_id long, {key} long, score double, rank int")
    probes = probes or spark.read.parquet(f"{path}/settings").first()["probes"]
    sizes = F.broadcast(spark.read.parquet(f"{path}/sizes"))
    wanted = with_lists(asked, "v", middle, len(middle) if exact else probes).withColumn("list", F.explode("lists")).join(sizes, "list")
    wanted = wanted.select("query_id", "v", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = spark.read.parquet(f"{path}/lists").withColumnRenamed("key", key)
    return top_k(_met(rows, wanted, key, k, "cosine", None, digits), "query_id", "score", key, k)


def compile_filter(must: list = (), should: list = (), must_not: list = ()) -> Column:
    """A predicate from (column, operator, value) clauses; all of must, any of should, none of must_not.

    Operators: eq, ne, in, not_in, contains, gt, ge, lt, le. On an array column eq
    and contains mean membership and in means overlap. A null never matches.
    """

    def one(clause: tuple) -> Column:
        name, op, value = clause[:3]
        c, many = F.col(name), len(clause) > 3 and clause[3] == "array"
        if op in ("eq", "contains") and many:
            out = F.array_contains(c, value)
        elif op == "in" and many:
            out = F.arrays_overlap(c, F.array(*map(F.lit, value)))
        elif op == "contains":
            out = F.contains(c, F.lit(value))
        elif op in ("in", "not_in"):
            out = c.isin(*value) if op == "in" else ~c.isin(*value)
        elif op in ("eq", "ne"):
            out = c == value if op == "eq" else c != value
        else:
            n = c.cast("double")
            out = {"gt": n > value, "ge": n >= value, "lt": n < value, "le": n <= value}[op]
        return F.coalesce(out, F.lit(False))

    out = F.lit(True)
    for x in must:
        out &= one(x)
    if should:
        some = F.lit(False)
        for x in should:
            some |= one(x)
        out &= some
    for x in must_not:
        out &= ~one(x)
    return out


def changes(stored: DataFrame, incoming: DataFrame, key: str, mark: str) -> DataFrame:
    """key and change: new, modified, unchanged or deleted."""
    s, i = stored.select(F.col(key), F.col(mark).alias("_s")), incoming.select(F.col(key), F.col(mark).alias("_i"))
    both = s.join(i, key, "full_outer")
    return both.select(key, F.when(F.col("_s").isNull(), "new").when(F.col("_i").isNull(), "deleted").when(F.col("_s") != F.col("_i"), "modified").otherwise("unchanged").alias("change"))


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Stored rows that no incoming row replaces, and the incoming rows."""
    return stored.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def point(points: DataFrame, key_value: object, key: str) -> DataFrame:
    """The point of one key, if there is one; the filter reaches the scan."""
    return points.where(F.col(key) == key_value)


def find_by_equipment(points: DataFrame, tag: str, key: str, limit: int = 20) -> DataFrame:
    """The first `limit` points, by key, that name a tag."""
    return points.where(F.array_contains("equipment", tag)).orderBy(key).limit(limit)


def find_by_document(points: DataFrame, document: str, key: str, limit: int = 100) -> DataFrame:
    return points.where(F.col("document") == document).orderBy(key).limit(limit)


def route(standards: Column, category: Column, name: Column) -> Column:
    """The collection of a chunk: the first rule that holds."""
    text = F.lower(F.concat_ws(" ", F.coalesce(category, F.lit("")), F.coalesce(name, F.lit(""))))
    has = lambda *xs: text.rlike("|".join(xs))
    return (
        F.when(has("p&id", "pid_"), "refinery_pid")
        .when(has("drawing"), "refinery_drawings")
        .when((F.size(standards) > 0) | has("safety", "oisd"), "refinery_safety")
        .when(has("inspection"), "refinery_inspection")
        .when(has("maintenance"), "refinery_maintenance")
        .when(has("sop", "procedure"), "refinery_sops")
        .when(has("email"), "refinery_emails")
        .when(has("manual"), "refinery_manuals")
        .otherwise("refinery_general")
    )
