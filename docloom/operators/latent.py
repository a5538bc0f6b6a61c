"""A dense embedding learnt from the corpus: the main directions of its tf-idf matrix by randomised subspace iteration.

The matrix has a row a text and a column a bucket of hashed terms; it is never made as such. Each round multiplies all texts with a matrix of
buckets by dimensions and back, by tasks that read their rows once and send what they add to each bucket; what the driver holds and
broadcasts is that one matrix, whose size goes by buckets and dimensions alone (36 MB at most as set here), however many texts there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.functions.text import SPARSE_BUCKETS
from docloom.operators.indexing import sparse_arrays
from docloom.session import spread, store

DIMENSIONS, MORE, ROUNDS = 64, 8, 4
#: Texts, and rows of sparse vectors, that a task works on at once.
TEXTS, ROWS = 256, 4096


def stored_terms(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, indices, values, as retrieval.term_vectors gives them, made many texts at once and stored: learning reads them once a round, embedding once more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                yield pa.RecordBatch.from_arrays([part.column(0), *sparse_arrays([t or "" for t in part.column(1).to_pylist()])], [key, "indices", "values"])

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, indices array<int>, values array<double>"
    return store(spread(docs.select(key, text)).mapInArrow(run, schema), "term-vectors")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS))


def _csr(batch: pa.RecordBatch, at: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds of rows, buckets, weights) of a batch's sparse vectors (columns at, at + 1): tf-idf, each row of unit length, or 0 for one without terms."""
    indices, values = (c.fill_null([]) if c.null_count else c for c in batch.columns[at : at + 2])
    bounds = indices.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    bucket = indices.flatten().to_numpy(zero_copy_only=False)
    weight = values.flatten().to_numpy(zero_copy_only=False) * idf[bucket]
    squares = np.concatenate([[0.0], np.cumsum(weight**2)])
    size = np.sqrt(squares[bounds[1:]] - squares[bounds[:-1]])
    return bounds, bucket, weight / np.repeat(np.where(size > 0, size, 1), np.diff(bounds))


def _sums(first: np.ndarray, size: np.ndarray, at: np.ndarray, weight: np.ndarray, matrix: np.ndarray, block: int = 1 << 13) -> np.ndarray:
    """Of each group of terms (so many from its first one on) the sum of the matrix's rows `at`, by weight. Groups of one size are multiplied together, about so many terms at once."""
    out = np.zeros((len(size), matrix.shape[1]))
    order = np.argsort(size, kind="stable")
    sizes, begin = np.unique(size[order], return_index=True)
    for n, groups in zip(sizes.tolist(), np.split(order, begin[1:])):
        step = max(1, block // max(1, n))
        for a in range(0, len(groups), step):
            some = groups[a : a + step]
            for b in range(0, n, block):
                terms = first[some][:, None] + np.arange(b, min(n, b + block))
                out[some] += (weight[terms][:, None, :] @ matrix[at[terms]])[:, 0]
    return out


def _rows_times(bounds: np.ndarray, bucket: np.ndarray, weight: np.ndarray, matrix: np.ndarray, block: int = 1 << 13) -> np.ndarray:
    """The sparse rows times the matrix; terms are taken so many at once."""
    return _sums(bounds[:-1], np.diff(bounds), bucket, weight, matrix, block)


def _times_rows(bounds: np.ndarray, bucket: np.ndarray, weight: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that the sparse rows have, and for each its column times `there` (a row of numbers a sparse row)."""
    row = np.repeat(np.arange(len(there), dtype=np.int32), np.diff(bounds))
    order = np.argsort(bucket.astype(np.uint16), kind="stable")  # SPARSE_BUCKETS are no more than its values, which numpy sorts by digits
    count = np.bincount(bucket, minlength=SPARSE_BUCKETS)
    met = np.flatnonzero(count)
    return met, _sums((np.cumsum(count) - count)[met], count[met], row[order], weight[order], there)


@dataclass
class Latent:
    """idf of each bucket and the directions (buckets by dimensions, orthonormal columns, the strongest first) with their strengths."""

    idf: np.ndarray
    directions: np.ndarray
    strengths: np.ndarray

    @staticmethod
    def fit(docs: DataFrame, text: str = "text", dimensions: int = DIMENSIONS, rounds: int = ROUNDS, seed: int = 7) -> Latent:
        """Learns from every text of docs; null and empty texts say nothing, repeated ones count each time. Equal tables in any order give equal
        directions up to sign and rounding. Fewer texts or terms than dimensions leave columns of zeros at the end."""
        return Latent.learn(stored_terms(docs.withColumn("_key", F.lit(0)), "_key", text), dimensions, rounds, seed)

    @staticmethod
    def learn(terms: DataFrame, dimensions: int = DIMENSIONS, rounds: int = ROUNDS, seed: int = 7) -> Latent:
        """fit() from stored_terms, which embed_terms can then use again."""
        rows = terms.select("indices", "values")
        met = rows.select(F.explode("indices").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).toPandas()  # SPARSE_BUCKETS rows at most
        n, df = rows.count(), np.zeros(SPARSE_BUCKETS)
        df[met["bucket"].to_numpy(np.int64)] = met["n"]
        idf = np.log((1 + n) / (1 + df)) + 1
        used = np.flatnonzero(df)
        # what tasks send to each other in a round is at most a quarter of the vectors' bytes, and no more than two tasks a core send
        sent = len(used) * (dimensions + MORE) * 8
        most = 2 * rows.sparkSession.sparkContext.defaultParallelism
        rows = rows.coalesce(min(most, max(1, int(12 * df.sum() // (4 * sent))))) if len(used) else rows
        matrix = np.zeros((SPARSE_BUCKETS, dimensions + MORE))
        matrix[used] = np.random.default_rng(seed).normal(size=(len(used), dimensions + MORE))
        strengths = np.zeros(dimensions)
        for _ in range(rounds if len(used) else 0):
            matrix = np.linalg.qr(matrix)[0]
            product = _there_and_back(rows, idf, matrix)
            # within the space so far: the directions in which the product is strongest
            values, inner = np.linalg.eigh(matrix.T @ product)
            order = np.argsort(-values)
            strengths, best, matrix = np.sqrt(np.maximum(values[order[:dimensions]], 0)), matrix @ inner[:, order], product @ inner[:, order]
        kept = best[:, :dimensions] * (strengths > 1e-9) if len(used) else matrix[:, :dimensions]
        return Latent(idf, kept, strengths)

    def embed(self, docs: DataFrame, key: str, text: str = "text") -> DataFrame:
        """key, vector (array<double>, of unit length; zeros for a text that tells nothing) for every row."""
        return self.embed_terms(stored_terms(docs, key, text), key)

    def embed_terms(self, terms: DataFrame, key: str) -> DataFrame:
        """embed() from stored_terms."""
        used = np.flatnonzero(self.directions.any(axis=1))
        held = terms.sparkSession.sparkContext.broadcast((self.idf, used, self.directions[used].astype(np.float32)))
        width = self.directions.shape[1]
        kind = to_arrow_type(terms.schema[key].dataType)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf, used, some_rows = held.value
            directions = np.zeros((len(idf), width))
            directions[used] = some_rows
            for batch in chain.from_iterable(map(_slices, batches)):
                found = _rows_times(*_csr(batch, 1, idf), directions)
                size = np.linalg.norm(found, axis=1, keepdims=True)
                unit = found / np.where(size > 0, size, 1)
                offsets = np.arange(len(unit) + 1, dtype=np.int32) * unit.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit.ravel()))], [key, "vector"])

        return terms.select(key, "indices", "values").mapInArrow(run, f"`{key}` {terms.schema[key].dataType.simpleString()}, vector array<double>")


def _there_and_back(rows: DataFrame, idf: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The transposed matrix of all rows times (the rows times a matrix): each task sends a row a bucket it has met, which are added up by bucket."""
    width = matrix.shape[1]
    used = np.flatnonzero(matrix.any(axis=1))
    held = rows.sparkSession.sparkContext.broadcast((idf, used, matrix[used]))
    names = [f"c{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, used, some_rows = held.value
        matrix = np.zeros((len(idf), width))
        matrix[used] = some_rows
        total, met = np.zeros_like(matrix), np.zeros(len(matrix), bool)
        for batch in chain.from_iterable(map(_slices, batches)):
            bounds, bucket, weight = _csr(batch, 0, idf)
            which, sums = _times_rows(bounds, bucket, weight, _rows_times(bounds, bucket, weight, matrix))
            total[which] += sums
            met[which] = True
        at = np.flatnonzero(met)
        for a in range(0, len(at), 4096):
            some = at[a : a + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(total[some, i]) for i in range(width)]], ["bucket", *names])

    parts = rows.mapInArrow(run, "bucket int, " + ", ".join(f"{c} double" for c in names))
    sums = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).toArrow()  # SPARSE_BUCKETS rows at most
    held.destroy()  # the next round has another
    out = np.zeros_like(matrix)
    at = sums["bucket"].to_numpy()
    for i, c in enumerate(names):  # column by column: no second copy of the whole
        out[at, i] = sums[c].to_numpy()
    return out
