"""Sparse and dense retrieval, rank fusion, context and answers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from docloom.functions.text import term_counts
from docloom.session import spread

TOP_K, PREFETCH, RRF_K = 8, 20, 60
#: Query vectors that a task holds at once, and so many queries of sparse ones.
BLOCK_BYTES, BLOCK_QUERIES = 64 << 20, 4096
#: Terms of a block of sparse rows, and products of their weights with those of queries that a task holds at once.
BLOCK_TERMS, BLOCK_PRODUCTS = 1 << 14, 1 << 21
NOTHING_FOUND = "No relevant context was found for this question."


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, bucket, tf, weight = 1 + ln(tf): counts of hashed terms, one row a key and term. Counted inside each row, nothing is shuffled."""
    counted = spread(docs.select(key, text)).select(key, F.inline(term_counts(F.col(text))))
    return counted.withColumn("weight", 1 + F.log(F.col("tf").cast("double")))


def term_vectors(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, indices, values: the postings of each row inside the row, by bucket; a text without terms has empty ones."""
    counted = spread(docs.select(key, text)).select(key, F.coalesce(term_counts(F.col(text)), F.array()).alias("t"))
    return counted.select(key, F.col("t.bucket").alias("indices"), F.transform("t.tf", lambda n: 1 + F.log(n.cast("double"))).alias("values"))


def ranked(scores: DataFrame, query: str, key: str, score: Column, k: int) -> DataFrame:
    """The best k of each query with ranks from 1; ties go by key."""
    order = Window.partitionBy(query).orderBy(F.col("score").desc(), key)
    return scores.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Best:
    """The best k keys of each query that a task has met so far, by falling score, ties by key."""

    def __init__(self, names: list, k: int):
        self.names, self.k = names, k
        self.scores: list[list[float]] = [[] for _ in names]
        self.keys: list[list] = [[] for _ in names]
        #: What a key must reach to be of use.
        self.least = np.full(len(names), -np.inf)

    def add(self, query: int, scores: np.ndarray, keys: list) -> None:
        """Scores of some keys (of unequal keys, the query's own so far aside), without those that are not numbers."""
        some = np.flatnonzero(scores >= self.least[query])
        if not len(some):
            return
        if len(some) > 4 * self.k:  # all of the k-th best score stay, for ties go by key
            some = some[scores[some] >= -np.partition(-scores[some], self.k - 1)[self.k - 1]]
        pairs = sorted([*zip((-s for s in self.scores[query]), self.keys[query]), *((-scores[j], keys[j]) for j in some)])[: self.k]
        self.scores[query], self.keys[query] = [-s for s, _ in pairs], [x for _, x in pairs]
        if len(pairs) == self.k:
            self.least[query] = self.scores[query][-1]

    def rows(self, queries: np.ndarray, rows: np.ndarray, keys: list) -> None:
        """Rows of queries' scores of some keys, not rounded yet, of which six digits count. Only what reaches a query's least is looked at one by one."""
        near = rows >= self.least[queries, None] - 1e-6
        for i in np.flatnonzero(near.any(axis=1)):
            some = np.flatnonzero(near[i])
            self.add(int(queries[i]), np.round(rows[i, some], 6), [keys[j] for j in some] if len(some) < len(keys) else keys)

    def batch(self, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
        """(query, key, score) rows."""
        which = [n for n, found in zip(self.names, self.keys) for _ in found]
        columns = [which, list(chain.from_iterable(self.keys)), list(chain.from_iterable(self.scores))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def query_blocks(queries: np.ndarray, keys: int) -> Iterator[np.ndarray]:
    """Queries, so many at once that they have about BLOCK_PRODUCTS scores with so many keys."""
    step = max(1, BLOCK_PRODUCTS // max(1, keys))
    return (queries[at : at + step] for at in range(0, len(queries), step))


def _kinds(queries: DataFrame, query: str, index: DataFrame, key: str) -> tuple[str, list[pa.DataType]]:
    """Schema and Arrow types of (query, key, score) rows."""
    found = [queries.schema[query].dataType, index.schema[key].dataType]
    return f"`{query}` {found[0].simpleString()}, `{key}` {found[1].simpleString()}, score double", [*map(to_arrow_type, found), pa.float64()]


class Asked:
    """Sparse queries by bucket: which ask for it, and with what weight."""

    def __init__(self, rows: list):
        self.names = [r[0] for r in rows]
        sizes = [len(r[1]) for r in rows]
        query = np.repeat(np.arange(len(rows)), sizes)
        bucket = np.fromiter(chain.from_iterable(r[1] for r in rows), np.int64, sum(sizes))
        weight = np.fromiter(chain.from_iterable(r[2] for r in rows), np.float64, sum(sizes))
        order = np.argsort(bucket, kind="stable")
        self.query, self.weight = query[order], weight[order]
        self.buckets, self.term = np.unique(bucket[order], return_inverse=True)

    def hits(self, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which terms of a block some query asks for, and their places among the queries' buckets."""
        at = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
        met = np.flatnonzero(self.buckets[at] == bucket)
        return met, at[met]


def score_block(asked: Asked, best: Best, doc: np.ndarray, bucket: np.ndarray, weight: np.ndarray, keys: list) -> int:
    """Adds a block's rows to the best of the queries that its bounds do not rule out; returns how many queries those were.

    A query's score in a row is at most the sum, over its buckets, of its weight and the block's largest: where that is below
    the k-th score the task has, no row of the block is looked at for the query.
    """
    met, at = asked.hits(bucket)
    if not len(met):
        return 0
    doc, weight = doc[met], weight[met]
    top = np.zeros(len(asked.buckets))
    np.maximum.at(top, at, weight)
    bound = np.bincount(asked.query, asked.weight * top[asked.term], len(asked.names))
    wanted = (bound > 0) & (bound >= best.least - 1e-6)  # scores are rounded to six digits
    live = np.flatnonzero(wanted)
    if not len(live):
        return 0
    # postings of those queries alone, by bucket
    kept = np.flatnonzero(wanted[asked.query])
    row, factor = (np.cumsum(wanted) - 1)[asked.query[kept]], asked.weight[kept]
    count = np.bincount(asked.term[kept], minlength=len(asked.buckets))
    begin = np.cumsum(count) - count
    total, size = np.zeros(len(live) * len(keys)), count[at]
    ends = np.cumsum(size)
    first = 0
    while first < len(at):  # so many products at once
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BLOCK_PRODUCTS, "right")))
        n = size[first:last]
        which = np.repeat(begin[at[first:last]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        total += np.bincount(row[which] * len(keys) + np.repeat(doc[first:last], n), factor[which] * np.repeat(weight[first:last], n), len(total))
        first = last
    for q, scores in zip(live, np.round(total.reshape(len(live), len(keys)), 6)):
        some = np.flatnonzero(scores)  # a row without a shared bucket is no hit
        best.add(int(q), scores[some], [keys[j] for j in some] if len(some) < len(keys) else keys)
    return len(live)


def sparse_blocks(batch: pa.RecordBatch, most: int = BLOCK_TERMS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
    """(row, bucket, weight, keys) of blocks of so many rows at most of a batch of (key, indices, values): rows of most weight first, so that later
    blocks have low bounds. A row of more terms than a block is one by itself. Only a block's terms are copied: a batch may be large."""
    held = [c.fill_null([]) if c.null_count else c for c in batch.columns[1:]]
    bounds = held[0].offsets.to_numpy()
    size, start = np.diff(bounds), bounds[:-1] - bounds[0]
    bucket, weight = (c.flatten().to_numpy(zero_copy_only=False) for c in held)
    some = np.flatnonzero(size)
    order = some[np.argsort(-np.add.reduceat(weight, start[some]), kind="stable")] if len(some) else some
    ends = np.cumsum(size[order])
    keys, first = batch.column(0), 0
    while first < len(order):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BLOCK_TERMS, "right")))
        last = min(last, first + most)
        rows = order[first:last]
        n = size[rows]
        at = np.repeat(start[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        yield np.repeat(np.arange(len(rows)), n), bucket[at].astype(np.int64), weight[at], keys.take(pa.array(rows)).to_pylist()
        first = last


def sparse_topk(queries: DataFrame, index: DataFrame, query: str, key: str, k: int = PREFETCH) -> DataFrame:
    """The best k rows of the index for each query by the dot product of their sparse vectors (indices, values; weights are not negative).

    Both are tables with one row a vector, so a score is made inside a row and no pair is shuffled. Tasks read the index in blocks, keep the
    best k of each query and skip, by upper bounds, what cannot be among them; what is shuffled is k rows a query and task. Queries go to the
    tasks in blocks of BLOCK_QUERIES. Rows that share no bucket with a query, and null keys' rows, are no hits; ties go by key.
    """
    schema, types = _kinds(queries, query, index, key)
    asked = queries.where(F.size("indices") > 0).select(query, "indices", F.col("values").cast("array<double>"))
    blocks = (asked.count() - 1) // BLOCK_QUERIES + 1
    rows = index.where(F.col(key).isNotNull()).select(key, F.col("indices").cast("array<int>").alias("indices"), F.col("values").cast("array<double>").alias("values"))
    found = None
    for block in range(max(1, blocks)):
        some = asked.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == block) if blocks > 1 else asked
        held = index.sparkSession.sparkContext.broadcast(Asked(some.collect()))  # about BLOCK_QUERIES rows

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            asked = held.value
            best = Best(asked.names, k)
            most = max(1, BLOCK_PRODUCTS // max(1, len(asked.names)))  # scores of a block: a row a query
            for batch in batches if asked.names else ():
                for doc, bucket, weight, keys in sparse_blocks(batch, most):
                    score_block(asked, best, doc, bucket, weight, keys)
            yield best.batch([query, key, "score"], types)

        scored = rows.mapInArrow(run, schema)
        found = scored if found is None else found.unionByName(scored)
    return ranked(found, query, key, F.col("score"), k)


def _unit(rows: list) -> np.ndarray:
    """Vectors of one length as rows of unit length; others, and those of length 0, as rows without a number."""
    size = max((len(v) for v in rows if v is not None), default=0)
    out = np.array([v if v is not None and len(v) == size else [np.nan] * size for v in rows], np.float64).reshape(len(rows), size)
    with np.errstate(invalid="ignore", divide="ignore"):
        return out / np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]


def dense_topk(queries: DataFrame, index: DataFrame, query: str, key: str, k: int = PREFETCH) -> DataFrame:
    """Exact cosine over all rows of the index, for a stated set of queries; ties go by key.

    Queries go to the tasks in blocks of at most BLOCK_BYTES. A task multiplies its rows with a block and keeps the best k of each
    query, so what is shuffled is k rows a query and task. Vectors of another length than the queries' match nothing.
    """
    schema, types = _kinds(queries, query, index, key)
    kinds = [F.col("vector").cast("array<double>").alias("vector")]
    held = queries.agg(F.sum(F.size("vector").cast("long") * 8 + 64)).first()[0] or 0
    blocks = int(held // BLOCK_BYTES) + 1
    found = None
    for block in range(blocks):
        some = queries.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == block) if blocks > 1 else queries
        rows = some.select(query, *kinds).collect()  # at most about BLOCK_BYTES
        asked = index.sparkSession.sparkContext.broadcast(([r[0] for r in rows], _unit([r[1] for r in rows])))

        def run(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            names, matrix = asked.value
            best = Best(names, k)
            for batch in batches:
                own = _unit(batch.column(1).to_pylist())
                if not len(names) or own.shape[1] != matrix.shape[1]:
                    continue
                keys = batch.column(0).to_pylist()
                for some in query_blocks(np.arange(len(names)), len(keys)):
                    best.rows(some, matrix[some] @ own.T, keys)
            yield best.batch([query, key, "score"], types)

        scored = index.select(key, *kinds).mapInArrow(run, schema)
        found = scored if found is None else found.unionByName(scored)
    return ranked(found, query, key, F.col("score"), k)


def rrf(rankings: list[DataFrame], query: str, key: str, k: int = TOP_K, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (constant + rank) over the rankings."""
    # k rows a query; dealt by other keys than the rest, for Spark 4.1 zips the partitions of a union whose sides are dealt alike,
    # which fails where adaptive execution has joined those of one side
    together = rankings[0].select(query, key, "rank").repartition(key)
    for r in rankings[1:]:
        together = together.unionByName(r.select(query, key, "rank"))
    fused = together.groupBy(query, key).agg(F.round(F.sum(1 / (F.lit(float(constant)) + F.col("rank"))), 9).alias("score"))
    return ranked(fused, query, key, F.col("score"), k)


def hybrid_search(queries: DataFrame, docs: DataFrame, query_vectors: DataFrame, doc_vectors: DataFrame, query: str, key: str, k: int = TOP_K, prefetch: int = PREFETCH) -> DataFrame:
    sparse = sparse_topk(term_vectors(queries, query), term_vectors(docs, key), query, key, prefetch)
    dense = dense_topk(query_vectors, doc_vectors, query, key, prefetch)
    return rrf([dense, sparse], query, key, k)


def contexts(hits: DataFrame, query: str, title: str = "doc_title") -> DataFrame:
    """One ordered list of blocks (rank, title, text, chunk_id, source_uri) a query; a block without a title is called by its chunk."""
    uri = F.col("source_uri") if "source_uri" in hits.columns else F.lit(None).cast("string").alias("source_uri")
    block = F.struct("rank", F.coalesce(F.nullif(F.col(title), F.lit("")), "chunk_id").alias("title"), "text", "chunk_id", uri)
    return hits.groupBy(query).agg(F.array_sort(F.collect_list(block)).alias("blocks"))


def first_citations(citations: DataFrame, query: str) -> DataFrame:
    """Each chunk's first citation, in the order of the answer."""
    w = Window.partitionBy(query, "chunk_id").orderBy("position")
    return citations.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def quote_first(question: str, blocks: list[dict]) -> dict:
    """The offline model: a reply that quotes the first block."""
    text = blocks[0]["text"]
    return {"content": [{"type": "text", "text": text, "citations": [{"cited_text": text, "document_index": 0}]}], "usage": None}


def answer(question: str, blocks: list[dict], model: Callable[[str, list[dict]], dict] | None = None) -> dict:
    """The model's answer with its citations resolved to chunks; without blocks a fixed text and no call.

    A reply has content blocks, of which those of type text count, in order; a reply of text and citations alone is one such block.
    """
    if not blocks:
        return {"text": NOTHING_FOUND, "citations": [], "usage": None}
    reply = (model or quote_first)(question, blocks)
    said = [b for b in reply.get("content", [{**reply, "type": "text"}]) if b["type"] == "text"]
    cited = [c for b in said for c in b.get("citations") or []]
    resolved = [{"cited_text": c["cited_text"], **{k: c[k] for k in ("start", "end") if k in c}, **{k: blocks[c["document_index"]].get(k) for k in ("chunk_id", "title", "source_uri")}} for c in cited]
    return {"text": "".join(b["text"] for b in said), "citations": resolved, "usage": reply.get("usage")}


def judge_prompt(question: str, reference: str, blocks: list[dict], said: str) -> str:
    """What a judging model is asked, for a reply that judge_scores reads."""
    criteria = "faithfulness (is the answer borne out by the context?), answer_relevance (does it meet the question?) and context_precision (how much of the context is of use?)"
    parts = {"Question": question, "Reference answer": reference, "Context": "\n\n".join(b["text"] for b in blocks), "Answer": said}
    return f"Rate a retrieval-based answer by {criteria}, each from 0 to 1. Reply with one JSON object of these three keys.\n\n" + "\n".join(f"{k}: {v}" for k, v in parts.items())


def read_scores(said: str) -> dict[str, float]:
    """The first JSON object of a judge's text as three numbers from 0 to 1, as text.judge_scores reads it; an error if there is none such."""
    names = ["faithfulness", "answer_relevance", "context_precision"]
    try:
        found, _ = json.JSONDecoder().raw_decode(said[said.index("{") :])
        scores = {n: found[n] for n in names}
    except (ValueError, KeyError, TypeError, AttributeError):
        scores = {}
    if len(scores) < 3 or any(isinstance(v, bool) or not isinstance(v, (int, float)) or not 0 <= v <= 1 for v in scores.values()):
        raise ValueError(f"not a judge's scores: {said}")
    return {n: float(v) for n, v in scores.items()}


def text_judge(ask: Callable[[str], dict]) -> Callable[[dict, list[dict], dict], dict]:
    """A judge for evaluate() from a text model: ask(prompt) gives {"text": ..., and input_tokens, output_tokens, cost_usd where known}. An answer without
    context is not judged by the model: nothing bears it out."""

    def judge(case: dict, blocks: list[dict], said: dict) -> dict:
        if not blocks:
            return {"faithfulness": 0.0, "answer_relevance": 0.0, "context_precision": 0.0, "cost_usd": 0.0}
        reply = ask(judge_prompt(case["question"], case["reference_answer"], blocks, said["text"]))
        return {**{n: reply.get(n) for n in ("input_tokens", "output_tokens", "cost_usd")}, **read_scores(reply["text"])}

    return judge
