"""Chunks to index points: payloads, vectors, the length guard."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import SPARSE_BUCKETS, approx_tokens, normalize_text, uuid5
from docloom.operators.chunking import SENT, chunk_documents, hashed_vectors, term_codes
from docloom.operators.registry import dim_guard
from docloom.operators.segment import metadata
from docloom.streaming.batching import SIZE

PAYLOAD = "chunk_id string, parent_doc_id string, text string, hierarchical_context array<string>, token_count bigint, doc_version string, doc_title string, source_uri string"
POINT = f"point_id string, {PAYLOAD}, dense array<double>, indices array<int>, values array<double>"


def payloads(docs: DataFrame, **bounds) -> DataFrame:
    """Chunk payloads of docs (doc_id, source_uri, mime_type, text); metadata travels with its document, no join."""
    carried = metadata(docs, pdf_title="pdf_title" if "pdf_title" in docs.columns else None).select("doc_id", "text", "mime_type", F.col("version").alias("doc_version"), F.col("title").alias("doc_title"), "source_uri")
    chunks = chunk_documents(carried, carry=["doc_version", "doc_title", "source_uri"], **bounds)
    return chunks.select("chunk_id", F.col("doc_id").cast("string").alias("parent_doc_id"), "text", F.col("breadcrumb").alias("hierarchical_context"), "token_count", "doc_version", "doc_title", "source_uri")


def sparse_arrays(texts: list[str]) -> tuple[pa.Array, pa.Array]:
    """Buckets in order and weights of each text's hashed terms."""
    row, code = term_codes(texts)
    met, n = np.unique(row * SPARSE_BUCKETS + code % SPARSE_BUCKETS, return_counts=True)
    offsets = pa.array(np.searchsorted(met // SPARSE_BUCKETS, np.arange(len(texts) + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array((met % SPARSE_BUCKETS).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(1 + np.log(n)))


def sparse_vector(text: str) -> tuple[list[int], list[float]]:
    bucket, weight = sparse_arrays([text])
    return bucket[0].as_py(), weight[0].as_py()


class PerWorker:
    """An embedder that each worker process makes once, when it first needs it: PerWorker(load_model)(texts)."""

    _made: dict[str, Callable] = {}

    def __init__(self, make: Callable[[], Callable]):
        self.make, self.name = make, uuid.uuid4().hex

    def __call__(self, texts: list[str]):
        if self.name not in PerWorker._made:
            PerWorker._made[self.name] = self.make()
        return PerWorker._made[self.name](texts)


def points(chunks: DataFrame, embed: Callable = hashed_vectors, dim: int = 384, size: int = SIZE, counted: bool = False) -> DataFrame:
    """Index points of normalized payloads, with `dropped` as a reason where there is no dense vector of the right length, and `failed` where the
    embedder raised: that may go well another time. raw_text is the text as it came, of those without a point alone; with counted, tokens_before and
    tokens_after are the counts of both.

    Dense and sparse vectors come from one pass over a batch, so they are columns of the chunk's own row. Chunks are embedded
    `size` at a time; a call that fails leaves those chunks alone without vectors. Nothing waits in a task.
    """

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SENT):
                part = batch.slice(at, SENT)
                texts, dense, why = part.column(0).to_pylist(), [], []
                for first in range(0, len(texts), size):
                    some = texts[first : first + size]
                    try:
                        found, error = [np.asarray(v, np.float64) for v in embed(some)], None
                    except Exception as raised:
                        found, error = [None] * len(some), f"embedding failed: {raised}".split("\n")[0]
                    dense += found
                    why += [error] * len(found)
                made = [pa.array(dense, pa.list_(pa.float64())), *sparse_arrays(texts), pa.array(why, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, "dense", "indices", "values", "failed"])

    raw = F.col("text")
    flat = chunks.select(F.coalesce(normalize_text(raw), F.lit("")).alias("text"), *[c for c in chunks.columns if c != "text"], raw.alias("raw_text"))
    if counted:
        flat = flat.withColumns({"tokens_before": approx_tokens(F.col("raw_text")), "tokens_after": approx_tokens(F.col("text"))})
    said = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema.fields)
    made = flat.mapInArrow(vectors, f"{said}, dense array<double>, indices array<int>, values array<double>, failed string").withColumn("point_id", uuid5(F.col("chunk_id")))
    told = dim_guard(made, dim, "dense").withColumn("dropped", F.coalesce("failed", "dropped"))
    return told.withColumn("raw_text", F.when(F.col("dropped").isNotNull(), F.col("raw_text")))
