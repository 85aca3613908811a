"""Nearest artifacts by cosine distance."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.package import ship


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if either has no length."""
    return 1 - F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def find(vectors: DataFrame, query: list[float], top_k: int, key: str, vector: str = "embedding", kinds: tuple[str, list] | None = None, max_distance: float | None = None) -> DataFrame:
    """The top_k nearest rows, with distance; the query vector is a literal, the top-k is taken in each task first."""
    rows = vectors.filter(F.col(kinds[0]).isin(kinds[1])) if kinds else vectors
    out = rows.withColumn("distance", cosine_distance(F.col(vector), F.array(*[F.lit(float(x)) for x in query])))
    if max_distance is not None:
        out = out.filter(F.col("distance") <= max_distance)
    return out.orderBy("distance", key).limit(top_k)


#: Rows that are compared with QUERY_ROWS queries in one matrix product, and what two computations of one distance may differ by.
BLOCK_ROWS, QUERY_ROWS, NEAR = 4096, 1024, 1e-9
#: Tasks that the rows of one cluster are dealt to.
CLUSTER_SPLITS = 16


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of a list column: those of length dim, without nulls, that have a direction."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(size == dim)
    x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), dim)
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    fine = length > 0  # neither null (NaN) nor zero
    return at[fine], x[fine] / length[fine, None]


class _Nearest:
    """The best so far of one task for a block of queries of one length."""

    def __init__(self, keys: list, queries: np.ndarray, centres: np.ndarray, centre_keys: list, top_k: int):
        self.keys, self.queries, self.centres, self.top_k = keys, queries, centres, top_k
        self.best: list[list[tuple[float, object]]] = [[] for _ in keys]
        self.compared = 0
        # The centres are rows themselves, so the k-th nearest row is no farther than the k-th nearest centre.
        self.to_centre = queries @ centres.T if len(centres) else np.zeros((len(keys), 0))
        own = {k: i for i, k in enumerate(centre_keys)}
        distance = 1 - self.to_centre
        for i, k in enumerate(keys):
            if k in own:
                distance[i, own[k]] = np.inf
        self.limit = np.partition(distance, top_k - 1, axis=1)[:, top_k - 1] + NEAR if len(centres) >= top_k else np.full(len(keys), np.inf)
        self.to_centre = np.arccos(np.clip(self.to_centre, -1, 1))

    def add(self, keys: list, rows: np.ndarray, cluster: int) -> None:
        """Compare rows of one cluster with the queries that they can be near enough to."""
        ask = np.arange(len(self.keys))
        if cluster >= 0:
            radius = float(np.arccos(np.clip(rows @ self.centres[cluster], -1, 1)).max())
            reach = np.arccos(np.clip(1 - self.limit, -1, 1))
            ask = np.flatnonzero(self.to_centre[:, cluster] - radius <= reach + NEAR)
        for lo in range(0, len(ask), QUERY_ROWS):
            some = ask[lo : lo + QUERY_ROWS]
            distance = 1 - self.queries[some] @ rows.T
            self.compared += distance.size
            q, r = np.nonzero(distance <= self.limit[some][:, None])
            if not len(q):
                continue
            exact = 1 - np.einsum("ij,ij->i", self.queries[some[q]], rows[r])
            edges = np.searchsorted(q, np.arange(len(some) + 1))
            for n in np.flatnonzero(np.diff(edges)).tolist():
                i, (a, b) = int(some[n]), edges[n : n + 2]
                near = [(d, keys[j]) for d, j in zip(exact[a:b].tolist(), r[a:b].tolist(), strict=True) if keys[j] != self.keys[i]]
                self.best[i] = heapq.nsmallest(self.top_k, self.best[i] + near)
                if len(self.best[i]) == self.top_k:
                    self.limit[i] = min(self.limit[i], self.best[i][-1][0] + NEAR)


def _clustered(vectors: DataFrame, key: str, vector: str, centres: np.ndarray, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, vector, cluster): each row beside those of its nearest centre, written once; -1 for rows of another length or without direction."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    rows = vectors.select(F.col(key).alias("__key"), F.col(vector).cast("array<double>").alias("__vector"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _unit(batch.column(1), shared.value.shape[1])
            cluster = np.full(batch.num_rows, -1, np.int32)
            cluster[at] = np.argmax(x @ shared.value.T, axis=1) if len(at) else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster)], ["__key", "__vector", "cluster"])

    kind = rows.schema["__key"].dataType.simpleString()
    laid = rows.mapInArrow(assign, f"__key {kind}, __vector array<double>, cluster int")
    return store(laid.repartition("cluster", F.pmod(F.xxhash64("__key"), F.lit(CLUSTER_SPLITS))).sortWithinPartitions("cluster"))


def find_each(vectors: DataFrame, queries: DataFrame, top_k: int, key: str, vector: str = "embedding", query_key: str = "query_id", block: int = 20_000, centres: int = 256, store: Callable[[DataFrame], DataFrame] = lambda df: df, compared: Accumulator | None = None) -> DataFrame:
    """The top_k nearest other rows of each query row by exact cosine distance, equal distances by key; rows without a distance or key don't count.

    Rows are laid out by the nearest of a few hundred of them (the centres). Queries go out in blocks of
    `block`, each in one pass over all rows: a task multiplies matrices of rows and queries, and leaves out those rows of
    a cluster that by angle to its centre, less its radius, are farther from a query than the
    top_k it has; it sends its top_k a query. Without clusters in the data everything is compared.
    `store` writes the layout and each pass's result where more than one pass reads or gives them; `compared` counts pairs.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = vectors.schema[key].dataType.simpleString()
    asked = queries.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("__key"), F.col(vector).cast("array<double>").alias("__vector"), F.size(vector).alias("__dim"))
    sizes = {r["__dim"]: r["count"] for r in asked.groupBy("__dim").count().collect()}
    nearest = Window.partitionBy("__query").orderBy("distance", "__key")
    parts = []
    for dim, n in sorted(sizes.items()):
        some = vectors.filter(F.size(vector) == dim).filter(F.col(key).isNotNull())
        chosen = some.orderBy(F.xxhash64(key), key).select(key, F.col(vector).cast("array<double>")).limit(centres).toArrow()
        at, middle = _unit(chosen.column(1).combine_chunks(), dim)
        names = chosen.column(0).take(pa.array(at)).to_pylist()
        rows = _clustered(some, key, vector, middle, store) if len(at) else some.select(F.col(key).alias("__key"), F.col(vector).cast("array<double>").alias("__vector"), F.lit(-1).alias("cluster"))
        blocks = -(-n // block)
        for b in range(blocks):
            mine = asked.filter((F.col("__dim") == dim) & (F.pmod(F.xxhash64("__key"), F.lit(blocks)) == b)).select("__key", "__vector").distinct().toArrow()
            shared = spark.sparkContext.broadcast((mine.column(0).to_pylist(), mine.column(1).combine_chunks() if mine.num_rows else pa.array([], pa.list_(pa.float64())), middle, names))

            def run(batches: Iterator[pa.RecordBatch], shared=shared, dim=dim) -> Iterator[pa.RecordBatch]:
                keys, vectors, middle, names = shared.value
                at, unit = _unit(vectors, dim)
                task, kind = _Nearest([keys[i] for i in at], unit, middle, names, top_k), None
                for batch in batches:
                    kind = batch.schema.field("__key").type
                    for lo in range(0, batch.num_rows, BLOCK_ROWS):
                        part = batch.slice(lo, BLOCK_ROWS)
                        places, x = _unit(part.column(1), dim)
                        ids, cluster = part.column(0).take(pa.array(places)).to_pylist(), part.column(2).to_numpy()[places]
                        for c in np.unique(cluster).tolist():
                            own = np.flatnonzero(cluster == c)
                            task.add([ids[i] for i in own], x[own], c)
                if compared is not None:
                    compared.add(task.compared)
                found = [(q, k, d) for q, best in zip(task.keys, task.best, strict=True) for d, k in best]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found], kind), pa.array([f[2] for f in found], pa.float64())], ["__query", "__key", "distance"])

            got = rows.mapInArrow(run, f"__query {kind}, __key {kind}, distance double")
            got = got.withColumn("position", F.row_number().over(nearest)).filter(F.col("position") <= top_k)
            parts.append(store(got) if blocks * len(sizes) > 1 else got)
    names = f"`{query_key}` {kind}, `{key}` {kind}, distance double, position int"
    if not parts:
        return spark.createDataFrame([], names)
    return reduce(DataFrame.unionByName, parts).select(F.col("__query").alias(query_key), F.col("__key").alias(key), "distance", "position")
