"""What the findings of round 3 left open: the learnt embedding and its search, and the memory of sparse search."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from docloom.operators import latent, retrieval
from docloom.operators.latent import Latent
from docloom.operators.vector_index import VectorIndex
from docloom.plans import queries
from docloom.session import new_path


def test_terms_are_made_once_and_learnt_from_as_sql_counts_them(spark, monkeypatch):
    """F8: one pass over the texts serves learning and embedding, with the terms that term_vectors gives."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["Kelvin", "Kelvin", "İx", "a1", "été", "x-y", "ss", "0"]) for _ in range(rng.randrange(0, 30))) for _ in range(300)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.doc_id: (r.indices, r.values) for r in retrieval.term_vectors(docs, "doc_id").collect()}
    got = {r.doc_id: (r.indices, r.values) for r in latent.stored_terms(docs, "doc_id").collect()}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and np.allclose(got[i][1], want[i][1], rtol=1e-15) for i in want)
    made = []
    plain = latent.stored_terms
    count = lambda *a, **k: made.append(1) or plain(*a, **k)
    monkeypatch.setattr(latent, "stored_terms", count)
    monkeypatch.setattr(queries, "stored_terms", count)
    monkeypatch.setattr(queries, "table", lambda *a: docs)
    queries.latent_neighbours(spark, "")
    assert len(made) == 1


@pytest.mark.parametrize("block", [2, 1 << 13])
def test_products_by_groups_of_a_size(block):
    """F8: both products of sparse rows equal those of the full matrix, with buckets that stand in one row, many and none."""
    rng = np.random.default_rng(2)
    dense = rng.normal(size=(40, 50)) * (rng.random((40, 50)) < np.linspace(0, 1, 50))
    row, bucket = np.nonzero(dense)
    bounds, weight = np.searchsorted(row, np.arange(41)), dense[row, bucket]
    matrix, there = rng.normal(size=(50, 3)), rng.normal(size=(40, 3))
    assert np.allclose(latent._rows_times(bounds, bucket, weight, matrix, block), dense @ matrix)
    met, sums = latent._times_rows(bounds, bucket, weight, there)
    assert list(met) == list(np.unique(bucket)) and np.allclose(sums, (dense.T @ there)[met])


def test_probed_lists_are_read_once_for_both_answers(spark, monkeypatch):
    """F8: the probed and the exact answer take two readings of lists, not three, and the second sends on only what reaches the k-th score."""
    rng = np.random.default_rng(4)
    rows = np.repeat(rng.normal(size=(150, 8)), 2, axis=0).tolist() + [[0.0] * 8, None, [1.0]]
    vectors = spark.createDataFrame(list(enumerate(rows)), "doc_id long, vector array<double>")
    index = VectorIndex.build(vectors, new_path(spark, "lists"), "doc_id", recall=0.3, k=5)
    asked = vectors.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "q")
    sent, plain = [], VectorIndex._scored

    def scored(*a, **k):
        sent.append(found := plain(*a, **k))
        return found

    monkeypatch.setattr(VectorIndex, "_scored", scored)
    near, exact = index.both(asked, "q", 5)
    assert len(sent) == 2
    least = {r.q: r.score for r in near.where("rank = 5").collect()}
    assert all(r.score >= least.get(r.q, -2) for r in sent[1].collect())
    order = lambda df: [(r.q, r.doc_id, r.score, r["rank"]) for r in df.orderBy("q", "rank").collect()]
    assert order(exact) == order(retrieval.dense_topk(asked, vectors, "q", "doc_id", 5)) == order(index.search(asked, "q", 5, exact=True))
    assert order(near) == order(index.search(asked, "q", 5)) and order(near) != order(exact)


def test_scores_of_many_queries_at_once():
    """F8: rows of scores give what one query at a time gives, with ties at the sixth digit and scores that are not numbers."""
    rng = np.random.default_rng(6)
    one, many = retrieval.Best(list(range(7)), 3), retrieval.Best(list(range(7)), 3)
    for block in range(6):
        scores = rng.integers(0, 5, size=(7, 9)) / 10 + rng.choice([0, 4e-7, -4e-7], size=(7, 9))
        scores[rng.random((7, 9)) < 0.1] = np.nan
        keys = [block * 9 + i for i in rng.permutation(9).tolist()]
        some = np.sort(rng.permutation(7)[:5])
        for q in some:
            one.add(int(q), np.round(scores[q], 6), keys)
        many.rows(some, scores[some], keys)
    assert one.keys == many.keys and one.scores == many.scores


def _sparse_batch(rows: int, terms: int) -> pa.RecordBatch:
    rng = np.random.default_rng(8)
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * terms)
    columns = [pa.array(np.arange(rows)), pa.ListArray.from_arrays(offsets, pa.array(rng.integers(0, 1000, rows * terms).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(1 + rng.random(rows * terms)))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "indices", "values"])


def test_blocks_copy_no_whole_batch():
    """what cutting a batch into blocks takes is far less than the batch, and each row comes once with its terms."""
    batch = _sparse_batch(3000, 300)
    tracemalloc.start()
    seen = sum(len(keys) for *_, keys in retrieval.sparse_blocks(batch))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 3000 and peak < batch.nbytes / 5, (peak, batch.nbytes)
    odd = pa.RecordBatch.from_pylist([{"k": 1, "i": [3, 5], "v": [1.0, 2.0]}, {"k": 2, "i": None, "v": None}, {"k": 3, "i": [], "v": []}, {"k": 4, "i": [3], "v": [9.0]}], pa.schema([("k", pa.int64()), ("i", pa.list_(pa.int32())), ("v", pa.list_(pa.float64()))]))
    for part, want in ((odd, [(4, [3], [9.0]), (1, [3, 5], [1.0, 2.0])]), (odd.slice(1), [(4, [3], [9.0])]), (odd.slice(1, 2), [])):
        got = [(key, bucket[doc == i].tolist(), weight[doc == i].tolist()) for doc, bucket, weight, keys in retrieval.sparse_blocks(part) for i, key in enumerate(keys)]
        assert got == want


def test_short_rows_and_many_queries_stay_bounded():
    """a block of rows of one term has no more scores with all queries than BLOCK_PRODUCTS."""
    batch, asked = _sparse_batch(8000, 1), retrieval.Asked([(q, [q % 1000], [1.0]) for q in range(2000)])
    most = retrieval.BLOCK_PRODUCTS // 2000
    blocks = [len(keys) for *_, keys in retrieval.sparse_blocks(batch, most)]
    assert sum(blocks) == 8000 and max(blocks) <= most
    tracemalloc.start()
    best = retrieval.Best(asked.names, 3)
    for block in retrieval.sparse_blocks(batch, most):
        retrieval.score_block(asked, best, *block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = retrieval.Best(asked.names, 3)
    for block in retrieval.sparse_blocks(batch):
        retrieval.score_block(asked, whole, *block)
    assert best.keys == whole.keys and best.scores == whole.scores and peak < 6 * 8 * retrieval.BLOCK_PRODUCTS, peak
