"""An index of dense vectors in inverted lists: each row lies in the list of its nearest centroid.

A search reads the lists whose centroids are nearest to some query; how many that takes is measured when the index is built. The exact mode
then reads the lists besides that could hold something better still, told by their radius, and gives what a comparison with every row gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.operators.retrieval import PREFETCH, Best, _kinds, _unit, query_blocks, ranked
from docloom.session import small, store

#: Rows that centroids and the number of probed lists are fitted on: those of the smallest key hashes over the whole table.
SAMPLE_ROWS, SAMPLE_BYTES, MOST_LISTS = 1 << 17, 128 << 20, 4096
#: Rows of the sample that are searched for.
TRIALS = 200
SLACK = 1e-3
#: Queries whose cosines to all centroids are held at once.
QUERIES = 2048


def unit_rows(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A column of vectors as rows of unit length; null ones, those of another length and those of length 0 are rows without a number."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fine = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    out = np.full((len(column), dim), np.nan)
    out[fine.to_numpy(zero_copy_only=False)] = column.filter(fine).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(invalid="ignore", divide="ignore"):
        return out / np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the first rows of a sample in random order; a centroid without rows takes the row worst off."""
    centroids = sample[:lists].copy()
    for _ in range(rounds):
        near, cosine = nearest(sample, centroids)
        order = np.argsort(near, kind="stable")
        held, first = np.unique(near[order], return_index=True)
        sums = np.zeros_like(centroids)
        sums[held] = np.add.reduceat(sample[order], first, axis=0)
        empty = np.setdiff1d(np.arange(len(centroids)), held)
        sums[empty] = sample[np.argsort(cosine, kind="stable")[: len(empty)]]
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 0, sums / np.where(size > 0, size, 1), centroids)
    return centroids


def nearest(rows: np.ndarray, centroids: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid and the cosine to it."""
    near, cosine = np.zeros(len(rows), np.int64), np.zeros(len(rows), rows.dtype)
    for at in range(0, len(rows), block):
        found = rows[at : at + block] @ centroids.T
        near[at : at + block] = found.argmax(axis=1)
        cosine[at : at + block] = found.max(axis=1)
    return near, cosine


def enough_probes(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> int:
    """The least number of lists that hold so much of the k nearest rows of trial rows, on average, by the sample alone."""
    trials = sample[:: max(1, len(sample) // TRIALS)]
    near, _ = nearest(sample, centroids)
    rank = np.argsort(np.argsort(-(trials @ centroids.T), axis=1, kind="stable"), axis=1)
    k = min(k, len(sample))
    needed = []
    for row, own in zip(trials, rank):
        best = np.argpartition(-(sample @ row), k - 1)[:k]
        needed.append(own[near[best]] + 1)
    share = np.bincount(np.concatenate(needed), minlength=len(centroids) + 1).cumsum() / (len(trials) * k)
    return int(np.searchsorted(share, recall))


@dataclass
class VectorIndex:
    """Lists under a folder: `lists` (key, vector, angle to the centroid; by list) and `meta` (a row a list)."""

    spark: SparkSession
    path: str
    key: str
    probes: int
    meta: pd.DataFrame
    table: DataFrame | None = None

    @staticmethod
    def build(rows: DataFrame, path: str, key: str, lists: int | None = None, recall: float = 0.97, k: int = PREFETCH) -> VectorIndex:
        """Indexes every row (key, vector). Rows with a null key, a null vector, one of length 0 or of another length than most of the sample's are in no list.

        Lists are about the root of the number of rows, MOST_LISTS at most. A list of any size is written by several tasks, for the table is
        rebalanced by size. Repeated rows are all kept.
        """
        spark, path = rows.sparkSession, path.rstrip("/")
        if key.lower() in ("list", "angle", "vector"):
            raise ValueError(f"a key named {key} clashes with a column of the lists")
        rows = rows.where(F.col(key).isNotNull() & (F.size("vector") > 0)).select(key, F.col("vector").cast("array<double>").alias("vector"))
        n, dim = rows.agg(F.count(F.lit(1)), F.mode(F.size("vector"))).first()
        if not n:
            dim = 1
        lists = min(lists or max(1, round(n**0.5)), MOST_LISTS)
        rows = rows.where(F.size("vector") == dim)
        bound = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
        sample = rows.orderBy(F.xxhash64(key), key).limit(bound).select("vector").toArrow()["vector"]
        # chunk by chunk: the driver holds the sample once as it came and once as rows
        held = np.concatenate([np.zeros((0, dim), np.float32), *(unit_rows(c, dim).astype(np.float32) for c in sample.chunks)])
        del sample
        held = held[~np.isnan(held).any(axis=1)]
        centroids = fit_centroids(held, min(lists, max(1, len(held)))) if len(held) else np.zeros((1, dim), np.float32)
        probes = enough_probes(held, centroids, k, recall) if len(held) else 1
        shared = spark.sparkContext.broadcast(centroids)
        kind = to_arrow_type(rows.schema[key].dataType)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit = _unit(batch.column(1).to_pylist()).astype(np.float32)
                fine = np.flatnonzero(~np.isnan(unit).any(axis=1))
                near, cosine = nearest(unit[fine], shared.value)
                some, angle = pa.array(fine), np.arccos(np.clip(cosine.astype(np.float64), -1, 1))
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), batch.column(0).take(some).cast(kind), pa.array(angle), batch.column(1).take(some)], ["list", key, "angle", "vector"])

        schema = f"list int, `{key}` {rows.schema[key].dataType.simpleString()}, angle double, vector array<double>"
        made = rows.mapInArrow(assign, schema)
        made.hint("rebalance", F.col("list")).write.partitionBy("list").parquet(f"{path}/lists")
        stats = spark.read.schema("list int, angle double").parquet(f"{path}/lists").groupBy("list").agg(F.count(F.lit(1)).alias("rows"), F.max("angle").alias("radius"))
        names = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<float>")  # at most MOST_LISTS
        meta = names.join(F.broadcast(stats), "list", "left").fillna({"rows": 0, "radius": 0.0})
        meta.select("list", "centroid", "rows", "radius", F.lit(probes).alias("probes"), F.lit(key).alias("key"), F.lit(schema).alias("schema")).coalesce(1).write.parquet(f"{path}/meta")
        return VectorIndex.load(spark, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> VectorIndex:
        meta = spark.read.parquet(f"{path}/meta").orderBy("list").toPandas()
        return VectorIndex(spark, path, meta["key"].iloc[0], int(meta["probes"].iloc[0]), meta)

    def rows(self, lists: np.ndarray | None = None) -> DataFrame:
        """list, key, angle, vector of some lists, or all: only those folders are read, and only the columns used."""
        if self.table is None:  # its folders are listed once
            self.table = self.spark.read.schema(self.meta["schema"].iloc[0]).parquet(f"{self.path}/lists")
        found = self.table
        return found if lists is None else found.where(F.col("list").isin([int(i) for i in lists]))

    def _scored(self, names: list, matrix: np.ndarray, chosen: np.ndarray, query: str, kinds: tuple, k: int, least: np.ndarray | None = None) -> DataFrame:
        """The best k of each query that each task finds in the lists chosen for it (a row of booleans a query), of those that reach its least score if there is one."""
        schema, types = kinds
        key = self.key
        shared = self.spark.sparkContext.broadcast((names, matrix, np.packbits(chosen.T, axis=1), least))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix, packed, least = shared.value
            best = Best(names, k)
            if least is not None:
                best.least = least.copy()
            for batch in batches:
                own, keys = batch.column(0).to_numpy(), batch.column(1)
                unit = unit_rows(batch.column(2), matrix.shape[1])
                for one in np.unique(own):
                    at, which = np.flatnonzero(own == one), np.flatnonzero(np.unpackbits(packed[one], count=len(names)))
                    named = keys.take(pa.array(at)).to_pylist()
                    for some in query_blocks(which, len(at)):
                        best.rows(some, matrix[some] @ unit[at].T, named)
            yield best.batch([query, key, "score"], types)

        # each task sends k rows a query, so there are no more than two tasks a core
        read = self.rows(np.flatnonzero(chosen.any(axis=0))).select("list", key, "vector").coalesce(2 * self.spark.sparkContext.defaultParallelism)
        return read.mapInArrow(run, schema)

    def search(self, queries: DataFrame, query: str, k: int = PREFETCH, exact: bool = False, probes: int | None = None) -> DataFrame:
        """query, key, score, rank and, the same in each row of a query, lists and rows_read (in those lists): the best k by cosine among
        the rows of the probed lists, or exactly among all rows.

        Queries (query, vector) are a stated set that the driver can hold, of which null vectors, those of another length and those of length 0 match nothing. The exact
        mode also reads each list whose radius does not rule it out against the query's k-th score so far. Ties go by key.
        """
        return self._search(queries, query, k, exact, probes)[int(exact)]

    def both(self, queries: DataFrame, query: str, k: int = PREFETCH) -> tuple[DataFrame, DataFrame]:
        """What search gives without and with exact, the probed lists being read once for both."""
        return self._search(queries, query, k, True, None)

    def _search(self, queries: DataFrame, query: str, k: int, exact: bool, probes: int | None) -> tuple[DataFrame, DataFrame | None]:
        held = queries.select(query, F.col("vector").cast("array<double>").alias("vector")).toArrow()
        centroids = np.nan_to_num(_unit(self.meta["centroid"].tolist()))
        unit = unit_rows(held["vector"], centroids.shape[1])
        fine = np.flatnonzero(~np.isnan(unit).any(axis=1))
        names, unit = held[query].take(pa.array(fine)).to_pylist(), unit[fine]
        kinds, sizes, radius = _kinds(queries, query, self.rows(), self.key), self.meta["rows"].to_numpy(), self.meta["radius"].to_numpy()
        chosen = np.zeros((len(unit), len(centroids)), bool)
        for at in range(0, len(unit), QUERIES):
            near = np.argsort(-(unit[at : at + QUERIES] @ centroids.T), axis=1, kind="stable")[:, : probes or self.probes]
            np.put_along_axis(chosen[at : at + QUERIES], near, True, axis=1)
        found = ranked(self._scored(names, unit, chosen, query, kinds, k), query, self.key, F.col("score"), k)
        if not exact:
            return self._told(found, names, chosen, queries, query), None
        found = store(found, "probed")
        least = {r[0]: r[1] for r in found.where(F.col("rank") == k).select(query, "score").collect()}  # a row a query
        reach = np.array([least.get(q, -2.0) for q in names])
        more = np.zeros_like(chosen)
        for at in range(0, len(unit), QUERIES):
            some = slice(at, at + QUERIES)
            bound = np.cos(np.maximum(0.0, np.arccos(np.clip(unit[some] @ centroids.T, -1, 1)) - radius - SLACK))
            more[some] = (bound >= reach[some, None] - 1e-6) & (sizes > 0) & ~chosen[some]
        rest = self._scored(names, unit, more, query, kinds, k, reach)
        whole = ranked(found.select(query, self.key, "score").unionByName(rest), query, self.key, F.col("score"), k)
        return self._told(found, names, chosen, queries, query), self._told(whole, names, chosen | more, queries, query)

    def _told(self, found: DataFrame, names: list, chosen: np.ndarray, queries: DataFrame, query: str) -> DataFrame:
        """Each query's rows with the lists chosen for it and the rows in them."""
        sizes = self.meta["rows"].to_numpy()
        told = [(q, int(c.sum()), int(sizes[c].sum())) for q, c in zip(names, chosen)]
        read = self.spark.createDataFrame(told, f"`{query}` {queries.schema[query].dataType.simpleString()}, lists long, rows_read long")
        return found.select(query, self.key, "score", "rank").join(small(read), query)
