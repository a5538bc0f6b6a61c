"""The retrieval engine against plain Python and DuckDB."""

import json
import random
import re
import uuid
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chunking, evaluation, registry, retrieval, segment
from docloom.plans import queries as engine
from docloom.sources.files import load_question_lines, load_questions, read_files, route, validate, watch_files
from docloom.streaming.batching import MicroBatcher, backoff, due, ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def hashable(x):
    return tuple(x) if isinstance(x, list) else x


@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, sql = engine.QUERIES[name](spark, SF), db.sql(engine.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    columns = sorted(df.columns)
    ours = Counter(tuple(hashable(r[c]) for c in columns) for r in df.collect())
    theirs = Counter(tuple(hashable(r[sql.columns.index(c)]) for c in columns) for r in sql.fetchall())
    assert ours == theirs


def test_normalization_rules(spark):
    rows = spark.createDataFrame([("Page 2 of 9\n=====\na  b c\r\n 1/2 \nPage 3\n--",)], "t string")
    assert rows.select(T.normalize_text(F.col("t"))).first()[0] == "a b c Page 3 --"


def test_white_space_is_that_of_python(spark):
    texts = [f"{chr(i)}a{chr(i)}b {chr(i)}c.{chr(i)} D {chr(i)}" for i in range(1, 0x3100)] + ["", " ", "a", " \n\t a  b\n c "]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = rows.select("t", T.collapse(F.col("t")).alias("flat"), T.word_count(F.col("t")).alias("n"), T.strip(F.col("t")).alias("s")).collect()
    for t, flat, n, s in got:
        assert (flat, n, s) == ((" ".join(t.split()), len(t.split()), t.strip()) if t is not None else (None, None, None)), repr(t)


def test_ids_and_terms(spark):
    row = spark.createDataFrame([("doc:é",)], "t string").select(T.uuid5(F.col("t")), T.term_bucket(F.col("t"))).first()
    assert row[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, "doc:é")) and row[1] == zlib.crc32("doc:é".encode()) % 65536


def test_markdown_breadcrumbs():
    text = "before\n# A\n### C\ndeep\n####### no\n#x\n# B\n"
    assert segment.markdown_segments(text) == [("before", []), ("deep\n####### no\n#x", ["A", "", "C"])]
    assert segment.markdown_segments("# only\n## headings") == []


def test_html_segments_repeat_nested_bodies():
    assert segment.html_segments("<h1>T</h1><li><p>x</p> y</li><div>gone</div>") == [("x y", ["T"]), ("x", ["T"])]


def test_segments_as_surveyed():
    assert segment.html_segments("<h1>Foo <b>Bar</b></h1><p>x") == [("x", ["FooBar"])]
    assert segment.html_segments("<h2>A &amp; B<p>in</p></h2><div><p>y</div>z") == [("in", ["", "A & Bin"]), ("y", ["", "A & Bin"])]
    assert segment.html_segments("<p>a<template>no</template><script>n</script><br>b<!-- c -->d</p>") == [("a b d", [])]
    assert segment.markdown_segments("## \nx\n#\ty \nz") == [("x", ["", ""]), ("z", ["y"])]


def test_metadata_as_surveyed(spark):
    md, html, pdf = "text/markdown", "text/html", "application/pdf"
    cases = [
        ("---\n  version: 5\n\ttitle: 'In'\n---\nx", md, "5", "In"), ("doc-version: 9", md, "1", None), ("DOC_version = 8", md, "8", None), ("<title>A &amp; B</title><meta name=version content=6>", html, "6", "A & B"),
        ("<title></title>title: no", html, "1", None), ("<title></title>\ntitle: L", html, "1", "L"), ("---\nversion: 3\n---\n", pdf, "3", "P"), ("---\ntitle: q\n---\nversion: 2", "text/plain", "2", "q"), ("version:\n\n7 x", md, "7 x", None),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(cases)], "i int, text string, mime_type string").withColumn("info", F.when(F.col("mime_type") == pdf, " P "))
    assert [(r.version, r.title) for r in segment.metadata(df, pdf_title="info").orderBy("i").collect()] == [(v, t) for *_, v, t in cases]


def test_page_markers(spark):
    lines = ["3 of 10", "PAGE 3 OF 10", " 3/10 ", "page 1 / 2", "٣ of ١٠", "Page 1", "1 of 2 x", "page of 3", "***", "-_=*", "--", "=== x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string")
    kept = [r.t for r in df.select("i", T.drop_boilerplate(F.col("t")).alias("t")).orderBy("i").collect()]
    assert kept == [""] * 5 + ["Page 1", "1 of 2 x", "page of 3", "", "", "--", "=== x"]


def test_term_counts(spark):
    df = spark.createDataFrame([(1, "b A b c, b"), (2, ""), (3, None), (4, "?")], "i int, t string")
    got = {r.i: {(x.bucket, x.tf) for x in r.p} for r in df.select("i", F.coalesce(T.term_counts(F.col("t")), F.array()).alias("p")).collect()}
    assert got == {1: {(zlib.crc32(w.encode()) % 65536, n) for w, n in (("a", 1), ("b", 3), ("c", 1))}, 2: set(), 3: set(), 4: set()}


@pytest.mark.parametrize("block", [64 << 20, 500])
def test_dense_topk_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", block)
    rng = random.Random(2)
    rows = [(f"k{i}", [float(rng.randrange(3)) for _ in range(4)] if i % 9 else [1.0]) for i in range(300)] + [("z", None), ("o", [0.0] * 4)]
    index, asked = spark.createDataFrame(rows, "key string, vector array<double>").repartition(5), spark.createDataFrame([(i, [1.0, float(i), 0.5, 2.0]) for i in range(12)], "q long, vector array<double>")
    want = set()
    for i in range(12):
        q = np.array([1.0, i, 0.5, 2.0])
        scored = [(-round(float(q @ v) / np.linalg.norm(q) / np.linalg.norm(v), 6), k) for k, v in rows if v and len(v) == 4 and any(v)]
        want |= {(i, k, n + 1) for n, (_, k) in enumerate(sorted(scored)[:7])}
    assert {(r.q, r.key, r.rank) for r in retrieval.dense_topk(asked, index, "q", "key", 7).collect()} == want


def test_metadata_ladder(spark):
    md, html = "text/markdown", "text/html"
    cases = [("---\nversion: '2.1'\ntitle: T\n---\nx", md, "2.1", "T"), ("Doc version = 7\nTitle: Q", md, "7", "Q"), ("x", md, "1", None), ('---\nversion: ""\n---\nversion: 3', md, "1", None), ('<title> H </title><meta name="version" content=" 4 ">', html, "4", "H"), ("\n" * 40 + "version: 9", md, "1", None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(cases)], "i int, text string, mime_type string")
    assert [(r.version, r.title) for r in segment.metadata(df).orderBy("i").collect()] == [(v, t) for *_, v, t in cases]


def test_fold_bounds():
    crumbs = [("a",)] * 3 + [("b",)] * 3
    assert chunking.fold([10] * 6, crumbs, None, 20, 200, 0.0) == [(0, 3), (3, 6)]
    assert chunking.fold([10] * 6, crumbs, None, 40, 200, 0.0) == [(0, 4), (4, 6)]
    assert chunking.fold([10] * 6, [()] * 6, None, 20, 30, 0.0) == [(0, 3), (3, 6)]
    v = np.array([[1.0, 0]] * 3 + [[0, 1.0]] * 3)
    assert chunking.fold([10] * 6, [()] * 6, v, 20, 500, 0.55) == [(0, 3), (3, 6)]
    assert chunking.fold([], [], None, 1, 2, 0.0) == []


def test_mean_similarity_is_of_members():
    rng = random.Random(3)
    v = np.array([[rng.random() for _ in range(5)] for _ in range(40)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = chunking.fold([1] * 40, [()] * 40, v, 2, 9, 0.8)
    want, start = [], 0
    for i in range(1, 40):
        far = np.mean([v[j] @ v[i] for j in range(start, i)]) < 0.8
        if i - start + 1 > 9 or far and i - start >= 2:
            want.append((start, i))
            start = i
    assert got == [*want, (start, 40)]


def test_registry_versions(spark):
    prior = spark.createDataFrame([("d", f"d:{i}", 3) for i in range(5)] + [("e", "e:0", 1)], "doc_id string, chunk_id string, version bigint")
    new = spark.createDataFrame([("d", f"d:{i}") for i in (0, 1, 2, 2, 7)], "doc_id string, chunk_id string")
    changes = registry.diff(prior, new)
    assert {(r.chunk_id, r.action, r.version) for r in changes.collect()} == {("d:0", "carry", 4), ("d:1", "carry", 4), ("d:2", "carry", 4), ("d:3", "delete", 4), ("d:4", "delete", 4), ("d:7", "insert", 4)}
    assert {tuple(r) for r in registry.apply(prior, changes).collect()} == {("d", "d:0", 4), ("d", "d:1", 4), ("d", "d:2", 4), ("d", "d:7", 4), ("e", "e:0", 1)}


def test_evaluation_and_gate(spark):
    cases = spark.createDataFrame([("c", "b.md"), ("n", "z")], "case_id string, expected string")
    hits = spark.createDataFrame([("c", 1, "a.md"), ("c", 2, "b.md")], "case_id string, rank int, source_uri string")
    got = {r.case_id: tuple(r)[1:] for r in evaluation.case_metrics(cases, hits, hits.select("case_id", "source_uri")).collect()}
    assert got == {"c": (1.0, 0.5, 0.5, 1.0), "n": (0.0, 0.0, 0.0, 0.0)}
    with pytest.raises(SystemExit):
        evaluation.gate(0.4, 0.5)


def test_answers():
    assert retrieval.answer("q", [])["text"] == retrieval.NOTHING_FOUND
    said = retrieval.answer("q", [{"text": "t", "chunk_id": "c:0", "title": "T"}])
    assert said["citations"] == [{"cited_text": "t", "chunk_id": "c:0", "title": "T", "source_uri": None}]
    blocks = [{"text": "t", "chunk_id": "c:0", "title": "T", "source_uri": "u"}]
    reply = {"content": [{"type": "thinking", "text": "no"}, {"type": "text", "text": "a"}, {"type": "text", "text": "b", "citations": [{"cited_text": "x", "document_index": 0}]}]}
    assert retrieval.answer("q", blocks, lambda q, b: reply) == {"text": "ab", "citations": [{"cited_text": "x", "chunk_id": "c:0", "title": "T", "source_uri": "u"}], "usage": None}
    assert "Reference answer: r" in retrieval.judge_prompt("q", "r", blocks, "a")


def test_micro_batcher_and_retries():
    now = [0.0]
    held = MicroBatcher(3, 2.0, lambda: now[0])
    assert not held.ready()
    held.add(1)
    now[0] = 2.0
    assert held.ready() and held.flush() == [1] and not held.ready()
    assert all(0 <= backoff(n) <= 60 for n in range(12))


def test_due_times(spark):
    """Full jitter under the ceiling of each retry, the same time for the same failure."""
    rows = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("k"), (F.col("id") % 8 + 1).cast("int").alias("attempts"))
    got = rows.select("attempts", due(F.lit(100.0), F.col("attempts"), "k").alias("at"))
    shares = [(r["at"] - 100) / min(60, 2 ** (r.attempts - 1)) for r in got.collect()]
    assert all(0 <= s < 1 for s in shares) and 0.45 < sum(shares) / len(shares) < 0.55 and got.collect() == got.collect()


def test_files_validate_route_and_stream(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    for name, body in {"a.md": b"# x", "b.MD": b"  ", "c.html": b"<p>x", "d.html": b"x", "e.exe": b"x", "f.md": b"\xff\xfe", "g.pdf": b"junk", ".md": b"x"}.items():
        (box / name).write_bytes(body)
    good, bad = route(validate(read_files(spark, str(box))))
    assert {re.sub(".*/", "", r.path) for r in good.collect()} == {"a.md", "c.html"}
    assert all(r.reason for r in bad.collect()) and bad.count() == 5  # a hidden file is not listed
    run = ingest(watch_files(spark, str(box)), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "state"))
    assert run.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 2 and spark.read.parquet(str(tmp_path / "bad")).count() == 5


def test_question_sets(spark, tmp_path):
    case = {"id": "1", "question": "q", "reference_answer": "r", "expected_source_uri_contains": "u"}
    path = tmp_path / "qa.json"
    for body, ok in (({"schema_version": 1, "dataset_version": "v", "cases": [case]}, True), ({"schema_version": 2, "dataset_version": "v", "cases": [case]}, False), ({"schema_version": 1, "dataset_version": "v", "cases": [case, case]}, False)):
        path.write_text(json.dumps(body))
        if ok:
            assert load_questions(spark, str(path)).count() == 1
        else:
            with pytest.raises(ValueError):
                load_questions(spark, str(path))


def test_question_lines(spark, tmp_path):
    case = {"dataset_version": "v", "id": "1", "question": "q", "reference_answer": "r", "expected_source_uri_contains": "u"}
    for lines, ok in (([case, {**case, "id": "2"}], True), ([case, case], False), ([case, {**case, "id": None}], False), ([{k: v for k, v in case.items() if k != "question"}], False)):
        (tmp_path / "qa.jsonl").write_text("\n".join(map(json.dumps, lines)))
        read = load_question_lines(spark, str(tmp_path / "qa.jsonl"))
        if ok:
            assert [r.id for r in read.orderBy("id").collect()] == ["1", "2"]
        else:
            with pytest.raises(Exception, match="a case needs"):
                read.collect()


def test_judge_from_prompt_to_scores():
    prompts = []

    def ask(prompt):
        prompts.append(prompt)
        return {"text": 'So:\n```json\n{"faithfulness": 1, "answer_relevance": 0.5, "context_precision": 0, "x": {"y": 1}}\n``` {}', "input_tokens": 7, "output_tokens": 2, "cost_usd": None}

    judge = retrieval.text_judge(ask)
    case, blocks = {"question": "q?", "reference_answer": "r"}, [{"text": "context"}]
    assert judge(case, blocks, {"text": "a"}) == {"input_tokens": 7, "output_tokens": 2, "cost_usd": None, "faithfulness": 1.0, "answer_relevance": 0.5, "context_precision": 0.0}
    assert all(x in prompts[0] for x in ("q?", "Reference answer: r", "context", "Answer: a"))
    assert judge(case, [], {"text": retrieval.NOTHING_FOUND})["faithfulness"] == 0.0 and len(prompts) == 1
    for bad in ("no", '{"faithfulness": true, "answer_relevance": 0.5, "context_precision": 0}', '{"faithfulness": 1.1, "answer_relevance": 0.5, "context_precision": 0}', "{}", "{no"):
        with pytest.raises(ValueError):
            retrieval.read_scores(bad)


def test_pdfs_are_valid_by_their_pages(spark):
    tree = ["<</Type/Catalog/Pages 2 0 R>>", "<</Type/Pages/Kids[3 0 R]/Count 1>>", "<</Type/Page/Parent 2 0 R/Contents 4 0 R>>"]
    index = "1 0 2 30 3 65 "
    packed = f"%PDF-1.5\n5 0 obj<</Type/ObjStm/N 3/First {len(index)}>>stream\n{index}{' '.join(tree)}\nendstream endobj 4 0 obj<</Length 9>>stream\nBT (Hello there) Tj ET\nendstream endobj\n%%EOF"
    rows = [("a.pdf", packed.encode()), ("b.pdf", b"%PDF-1.4 prose of /Type /Page and %%EOF"), ("c.pdf", packed.encode() + b"/Encrypt"), ("d.pdf", b""), ("e.pdf", None), ("f.md", b"# x")]
    got = {r.path: (r.ok, r.reason) for r in validate(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"a.pdf": (True, None), "b.pdf": (False, "PDF has no pages"), "c.pdf": (False, "PDF is encrypted"), "d.pdf": (False, "not a PDF"), "e.pdf": (False, "not a PDF"), "f.md": (True, None)}
    given = validate(spark.createDataFrame(rows[1:2], "path string, content binary"), pdf_pages=lambda content: [])
    assert given.first().reason == "PDF has no pages"
