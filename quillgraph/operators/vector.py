"""Exact nearest neighbours and similar pairs over array columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.operators.best import Best
from quillgraph.plans.runtime import cut, ship

#: Query vectors held by a task at a time (8,192 of 1,536 dimensions take 100 MB).
BLOCK = 8192


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    """0 where a vector is zero."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


#: Cells of a tile of queries by rows (64 MB of doubles).
TILE = 8 << 20


def _held(asked: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Ids, unit vectors and groups (or none) of a stated query set asked(qid, v, g?), in blocks of at most BLOCK."""

    ship(asked.sparkSession)

    def block(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, list]:
        t = rows.select("qid", "v", *(["g"] if "g" in asked.columns else [])).toArrow().combine_chunks()
        v = t.column("v")
        return t.column("qid").to_numpy(), _matrix(v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v), t.column("g").to_pylist() if "g" in t.column_names else []

    first = block(asked.limit(BLOCK + 1))
    if len(first[0]) <= BLOCK:
        yield from [first] if len(first[0]) else []
        return
    blocks = -(-asked.count() // (BLOCK // 2))
    tagged = cut(asked.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks))))
    for i in range(blocks):
        held = block(tagged.where(F.col("block") == i))
        if len(held[0]):
            yield held


def _ranked(found: list[DataFrame], k: int, spark: SparkSession) -> DataFrame:
    if not found:
        return spark.createDataFrame([], "qid bigint, pos int, key bigint, similarity double")
    w = Window.partitionBy("qid").orderBy(F.desc("similarity"), "key")
    return reduce(DataFrame.unionByName, found).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).select("qid", "pos", "key", "similarity")


def top_k(base: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``qid, pos, key, similarity`` of the k most similar base rows per query, exact; ties by key.

    Queries are a stated set, taken in blocks of BLOCK. A task multiplies its rows with a block in tiles of bounded
    size and keeps its own k best per query, so at most k rows per query and task are shuffled. Null vectors are not
    searched.
    """
    rows = base.select(F.col(key).alias("key"), F.col(vector).alias("v")).where(F.col("v").isNotNull())
    found = []
    for held in _held(queries.select(F.col(key).alias("qid"), F.col(vector).alias("v")).where(F.col("v").isNotNull())):
        shared = base.sparkSession.sparkContext.broadcast(held)

        def best(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, _ = shared.value
            top, step = Best(len(ids), k), max(k, TILE // len(ids))
            for b in parts:
                m, keys = _matrix(b.column(1)), b.column(0).to_numpy()
                for at in range(0, len(keys), step):
                    top.add(np.round(q @ m[at : at + step].T, 6), keys[at : at + step])
            query, keys, similarity = top.rows()
            yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(keys.astype(np.int64)), pa.array(similarity)], names=["qid", "key", "similarity"])

        found.append(rows.mapInArrow(best, "qid bigint, key bigint, similarity double"))
    return _ranked(found, k, base.sparkSession)


def similar_rows(base: DataFrame, queries: DataFrame, group: str, threshold: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Candidate merges for review: of a stated query set, every row of the same group with a cosine of at least threshold.

    ``group, a, b, similarity`` with a the query. Queries go in blocks of BLOCK past all rows, which are multiplied in
    tiles with the queries of their own groups alone; only what reaches the threshold leaves a task.
    """
    ints = queries.schema[group].dataType.simpleString()
    rows = base.select(F.col(group).alias("g"), F.col(key).alias("key"), F.col(vector).alias("v")).where(F.col("v").isNotNull() & F.col("g").isNotNull())
    found = []
    asked = queries.select(F.col(key).alias("qid"), F.col(vector).alias("v"), F.col(group).alias("g")).where(F.col("v").isNotNull() & F.col("g").isNotNull())
    for ids, q, groups in _held(asked):
        shared = base.sparkSession.sparkContext.broadcast((ids, q, np.array(groups, object)))

        def near(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, of = shared.value
            mine = {g: np.flatnonzero(of == g) for g in set(of.tolist())}
            for b in parts:
                m, keys, gs = _matrix(b.column(2)), b.column(1).to_numpy(), np.array(b.column(0).to_pylist(), object)
                for g in set(gs.tolist()) & mine.keys():
                    r, a = np.flatnonzero(gs == g), mine[g]
                    for at in range(0, len(r), step := max(1, TILE // len(a))):
                        some = r[at : at + step]
                        sim = np.round(q[a] @ m[some].T, 6)
                        i, j = np.nonzero((sim >= threshold) & (ids[a][:, None] != keys[some][None, :]))
                        yield pa.RecordBatch.from_arrays([pa.array([g] * len(i), b.schema.field(0).type), pa.array(ids[a[i]]), pa.array(keys[some[j]]), pa.array(sim[i, j])], names=["g", "a", "b", "similarity"])

        found.append(rows.mapInArrow(near, f"g {ints}, a bigint, b bigint, similarity double"))
    if not found:
        return base.sparkSession.createDataFrame([], f"`{group}` {ints}, a bigint, b bigint, similarity double")
    return reduce(DataFrame.unionByName, found).withColumnRenamed("g", group)


#: Rows cells are fitted and probes measured on: those whose keys hash lowest; and how many of them ask.
SAMPLE, ASKING = 20_000, 200


def _sample(base: DataFrame, sample: int, key: str, vector: str) -> np.ndarray:
    rows = base.where(F.col(vector).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(key).alias("k"), F.col(vector).alias("v")).orderBy("h", "k").limit(sample).toArrow().combine_chunks()
    v = rows.column("v")
    return _matrix(v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v)


def fit_cells(base: DataFrame, n_cells: int, sample: int = SAMPLE, key: str = "vec_id", vector: str = "embedding", rounds: int = 12) -> np.ndarray:
    """Unit centroids by spherical k-means on a bounded sample of the rows."""
    m = _sample(base, sample, key, vector)
    if not len(m):
        return np.zeros((0, 0))
    c = m[np.linspace(0, len(m) - 1, min(n_cells, len(m))).astype(int)]
    for _ in range(rounds):
        at = (m @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, m)
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(n > 0, sums / np.maximum(n, 1e-12), c)
    return c


def fit_probes(base: DataFrame, centroids: np.ndarray, k: int, recall: float = 0.95, sample: int = SAMPLE, key: str = "vec_id", vector: str = "embedding") -> int:
    """The fewest cells a query must probe to find ``recall`` of its k nearest, measured on the sample against brute force.

    Vectors in clusters need few; where they fill space evenly, most cells hold some neighbour.
    """
    m = _sample(base, sample, key, vector)
    if not len(m) or not len(centroids):
        return 1
    q = m[:ASKING]
    exact = np.argpartition(-(q @ m.T), min(k, len(m)) - 1, axis=1)[:, :k]
    order = np.argsort(-(q @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centroids)), order.shape), axis=1)
    needed = np.take_along_axis(place, (m @ centroids.T).argmax(axis=1)[exact], axis=1)
    return int(np.quantile(needed, recall, method="higher")) + 1


def in_cells(base: DataFrame, centroids: np.ndarray, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``cell, key, v``: every vector in its nearest cell."""
    ship(base.sparkSession)
    shared = base.sparkSession.sparkContext.broadcast(centroids)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            cell = (_matrix(b.column(1)) @ shared.value.T).argmax(axis=1) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *b.columns], names=["cell", "key", "v"])

    rows = base.select(F.col(key).alias("key"), F.col(vector).alias("v")).where(F.col("v").isNotNull())
    return rows.mapInArrow(run, f"cell int, key {base.schema[key].dataType.simpleString()}, v {base.schema[vector].dataType.simpleString()}")


def top_k_cells(index: DataFrame, queries: DataFrame, k: int, centroids: np.ndarray, probes: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Approximate ``top_k`` over index(cell, key, v): a query is multiplied with the rows of its ``probes`` nearest cells only.

    Of a stored index only the probed cells are read. A task takes its rows cell by cell, so a cell however large is
    spread over tasks, and passes on its k best per query.
    """
    spark, found = index.sparkSession, []
    for ids, q, _ in _held(queries.select(F.col(key).alias("qid"), F.col(vector).alias("v")).where(F.col("v").isNotNull())):
        if not len(centroids):
            break
        near = np.argsort(-(q @ centroids.T), axis=1, kind="stable")[:, :probes]
        askers = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
        shared = spark.sparkContext.broadcast((ids, q, askers))

        def best(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, askers = shared.value
            top = Best(len(ids), k)
            for b in parts:
                cells, keys, m = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2))
                for c in np.unique(cells).tolist():
                    if (mine := askers.get(c)) is None:
                        continue
                    rows = np.flatnonzero(cells == c)
                    for at in range(0, len(rows), step := max(k, TILE // len(mine))):
                        some = rows[at : at + step]
                        top.add_some(mine, np.round(q[mine] @ m[some].T, 6), keys[some])
            query, keys, similarity = top.rows()
            yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(keys.astype(np.int64)), pa.array(similarity)], names=["qid", "key", "similarity"])

        probed = index.where(F.col("cell").isin(list(askers))) if len(askers) < len(centroids) else index
        found.append(probed.select("cell", "key", "v").mapInArrow(best, "qid bigint, key bigint, similarity double"))
    return _ranked(found, k, spark)
