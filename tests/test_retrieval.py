"""Top-k retrieval by bounds and by inverted lists, against comparisons with every row."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import retrieval
from docloom.operators.vector_index import VectorIndex


def plain_topk(asked, rows, k):
    out = set()
    for q, left in asked:
        hits = [(-round(sum(w * right[b] for b, w in left.items() if b in right), 6), key) for key, right in rows if key is not None and left.keys() & right.keys()]
        out |= {(q, key, -s, i + 1) for i, (s, key) in enumerate(sorted(hits)[:k])}
    return out


def sparse(spark, rows, name):
    made = [(k, sorted(v), [float(v[b]) for b in sorted(v)]) if v is not None else (k, None, None) for k, v in rows]
    return spark.createDataFrame(made, f"{name} long, indices array<int>, values array<double>")


@pytest.mark.parametrize("terms, products, queries", [(1 << 14, 1 << 21, 4096), (7, 5, 4096), (64, 1, 3)])
def test_sparse_topk(spark, monkeypatch, terms, products, queries):
    """Blocks of any size, ties, nulls, empty vectors and hot buckets give what plain sums give."""
    for name, value in (("BLOCK_TERMS", terms), ("BLOCK_PRODUCTS", products), ("BLOCK_QUERIES", queries)):
        monkeypatch.setattr(retrieval, name, value)
    rng = random.Random(terms)
    vector = lambda n: {0: 1.0} | {rng.randrange(40): rng.choice([0.5, 1.0, 1.0 + rng.random()]) for _ in range(rng.randrange(n))}
    rows = [(i, vector(20)) for i in range(300)] + [(None, vector(9)), (900, {}), (901, {7: 1.0}), (902, {7: 1.0})]
    asked = [(i, vector(9)) for i in range(8)] + [(50, {}), (51, {7: 2.0}), (52, {99: 1.0})]
    index = sparse(spark, rows, "key").unionByName(sparse(spark, [(903, None)], "key"))
    got = {tuple(r) for r in retrieval.sparse_topk(sparse(spark, asked, "q"), index, "q", "key", 5).collect()}
    assert got == plain_topk(asked, rows, 5)
    assert retrieval.sparse_topk(sparse(spark, asked, "q").limit(0), index, "q", "key").count() == 0
    assert retrieval.sparse_topk(sparse(spark, asked, "q"), index.limit(0), "q", "key").count() == 0


def test_bounds_skip_blocks():
    """Once k rows are good enough, blocks of light rows are not looked at; no row is lost."""
    asked = retrieval.Asked([(0, [1, 2], [1.0, 1.0]), (1, [3], [1.0])])
    best = retrieval.Best(asked.names, 2)
    block = lambda weight, n: (np.repeat(np.arange(n), 2), np.tile([1, 2], n), np.full(2 * n, weight), list(range(n)))
    assert retrieval.score_block(asked, best, *block(5.0, 3)) == 1 and best.scores[0] == [10.0, 10.0]
    assert retrieval.score_block(asked, best, *block(1.0, 50)) == 0
    assert retrieval.score_block(asked, best, *block(6.0, 1)) == 1 and best.scores == [[12.0, 10.0], []]


def test_sparse_topk_shuffles_no_pairs(spark):
    words = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 17}" for j in range(1, 9))) for i in range(60)], "doc_id long, text string")
    vectors = retrieval.term_vectors(words, "doc_id")
    asked = vectors.withColumnRenamed("doc_id", "item_id")
    plan = retrieval.sparse_topk(asked, vectors.hint("coalesce", 2), "item_id", "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning(item_id") == 1


def vectors(spark, rows, name="key"):
    return spark.createDataFrame([(k, None if v is None else [float(x) for x in v]) for k, v in rows], f"{name} long, vector array<double>")


def cosine_topk(asked, rows, k):
    unit = lambda v: np.array(v, float) / np.linalg.norm(v)
    kept = [(key, unit(v)) for key, v in rows if key is not None and v is not None and len(v) == 8 and any(v)]
    return {(q, key, i + 1) for q, v in asked for i, (_, key) in enumerate(sorted((-round(float(u @ unit(v)), 6), key) for key, u in kept)[:k])}


def test_inverted_lists(spark, tmp_path):
    """Clustered vectors: few lists hold the nearest. The exact mode equals a comparison with all, whatever was probed."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(20, 8))
    rows = [(i, (centers[i % 20] + 0.3 * rng.normal(size=8)).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[3][1]) for i in range(700)]  # a third are copies of one
    odd = [(None, rows[0][1]), (9001, None), (9002, [0.0] * 8), (9003, [1.0, 2.0]), (9004, [])]
    index = VectorIndex.build(vectors(spark, rows + odd), str(tmp_path / "i"), "key", k=10)
    assert index.meta["rows"].sum() == len(rows)
    asked = [(i, rows[i][1]) for i in range(0, 1500, 100)] + [(5000, rng.normal(size=8).tolist())]
    held = vectors(spark, asked + [(6000, None), (6001, [1.0]), (6002, [0.0] * 8)], "q")
    want = cosine_topk(asked, rows, 10)
    for probes in (1, None, 1000):
        exact = index.search(held, "q", 10, exact=True, probes=probes).collect()
        assert {(r.q, r.key, r["rank"]) for r in exact} == want
    near = VectorIndex.load(spark, str(tmp_path / "i")).search(held, "q", 10).collect()
    assert len({(r.q, r.key) for r in near} & {w[:2] for w in want}) >= 0.9 * len(want)
    assert np.mean([r.rows_read for r in near if r.q != 3]) < 0.7 * len(rows) and index.probes < 15


def test_inverted_lists_of_few_and_no_rows(spark, tmp_path):
    one = [(1, [1.0] + [0.0] * 7)]
    index = VectorIndex.build(vectors(spark, one), str(tmp_path / "one"), "key")
    assert [(r.q, r.key, r.score) for r in index.search(vectors(spark, [(5, [2.0] + [0.0] * 7)], "q"), "q", exact=True).collect()] == [(5, 1, 1.0)]
    assert index.search(vectors(spark, [], "q"), "q").count() == 0
    none = VectorIndex.build(vectors(spark, []), str(tmp_path / "none"), "key")
    assert none.search(vectors(spark, [(5, [1.0])], "q"), "q", exact=True).count() == 0
    with pytest.raises(ValueError):
        VectorIndex.build(vectors(spark, one, "list"), str(tmp_path / "x"), "list")


def test_only_probed_lists_are_read(spark, tmp_path):
    rng = np.random.default_rng(1)
    index = VectorIndex.build(vectors(spark, [(i, rng.normal(size=8).tolist()) for i in range(200)]), str(tmp_path / "i"), "key", lists=8)
    some = index.rows(np.array([2, 5]))
    assert {r[0] for r in some.select("list").distinct().collect()} <= {2, 5}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[list#\d+ IN \(2,5\)", plan) or re.search(r"onFilters: \[list#\d+ IN \(2,5\)", plan)
    assert sum(index.meta["rows"][[2, 5]]) == some.count()
