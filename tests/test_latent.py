"""The learnt embedding against numpy's decomposition, and against the hashed one in finding passages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import latent, retrieval
from docloom.operators.chunking import hashed_vectors
from docloom.operators.indexing import sparse_vector
from docloom.operators.latent import Latent
from docloom.session import table

SF = "/root/testdata/sf0.01"


def test_directions_equal_a_decomposition(spark):
    rng = random.Random(3)
    topics = [[f"t{k}w{i}" for i in range(12)] for k in range(5)]
    texts = [" ".join(rng.choice(topics[i % 5] if rng.random() < 0.9 - 0.1 * (i % 5) else topics[rng.randrange(5)]) for _ in range(rng.randrange(3, 40))) for i in range(200)] + ["", None, texts_alike := "same words same words"] + [texts_alike] * 3
    model = Latent.fit(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), dimensions=4, rounds=12)
    vectors = [sparse_vector(t or "") for t in texts]
    df = np.zeros(latent.SPARSE_BUCKETS)
    for b, _ in vectors:
        df[b] += 1
    matrix = np.zeros((len(texts), latent.SPARSE_BUCKETS))
    for row, (b, w) in zip(matrix, vectors):
        row[b] = np.array(w) * (np.log((1 + len(texts)) / (1 + df[b])) + 1)
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    _, strengths, directions = np.linalg.svd(matrix / np.where(size > 0, size, 1), full_matrices=False)
    assert np.allclose(model.strengths, strengths[:4], rtol=1e-6)
    assert np.allclose(np.abs(np.sum(model.directions * directions[:4].T, axis=0)), 1, atol=1e-5)
    assert np.allclose(model.directions.T @ model.directions, np.eye(4), atol=1e-9)
    embedded = {r.k: r.vector for r in model.embed(spark.createDataFrame([(1, texts[0]), (2, ""), (3, None)], "k long, text string"), "k").collect()}
    want = (matrix[0] / size[0]) @ model.directions
    assert np.allclose(embedded[1], want / np.linalg.norm(want)) and embedded[2] == embedded[3] == [0.0] * 4


def test_few_and_no_texts(spark):
    none = spark.createDataFrame([], "text string")
    assert not Latent.fit(none).directions.any()
    two = Latent.fit(spark.createDataFrame([("a b",), ("c d",)], "text string"), dimensions=5)
    assert np.count_nonzero(two.strengths > 1e-9) == 2 and np.isfinite(two.directions).all()


def test_it_finds_passages_better_than_hashed_counts(spark):
    """Benchmark passages that stand in documents: in the top eight more often than by hashed counts of as many dimensions."""
    docs, bench = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "benchmark").select("item_id", "text")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    held = {r.item_id: {d for d, t in texts if r.text in t} for r in bench.collect()}
    held = {i: found for i, found in held.items() if found}
    assert len(held) >= 5
    model = Latent.fit(docs, dimensions=48)
    hashed = F.pandas_udf(lambda s: __import__("pandas").Series([v.tolist() for v in hashed_vectors([t or "" for t in s], 48)]), "array<double>")
    rate = {}
    for name, embed in (("latent", lambda df, key: model.embed(df, key)), ("hashed", lambda df, key: df.select(key, hashed("text").alias("vector")))):
        top = retrieval.dense_topk(embed(bench, "item_id"), embed(docs, "doc_id"), "item_id", "doc_id", 8).collect()
        rate[name] = np.mean([bool(found & {r.doc_id for r in top if r.item_id == i}) for i, found in held.items()])
    assert rate["latent"] > rate["hashed"], rate


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_blocks_of_terms(block):
    rng = np.random.default_rng(1)
    bounds, bucket, weight, matrix = np.array([0, 2, 2, 9]), rng.integers(0, 20, 9), rng.normal(size=9), rng.normal(size=(20, 3))
    want = np.array([sum((weight[i] * matrix[bucket[i]] for i in range(a, b)), np.zeros(3)) for a, b in zip(bounds, bounds[1:])])
    assert np.allclose(latent._rows_times(bounds, bucket, weight, matrix, block), want)
