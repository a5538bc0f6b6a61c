"""Files to index to evaluation, the keyed log and records, against expected rows."""

import json
import uuid
import zlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import indexing
from docloom.plans.pipelines import Engine, evaluate, evaluation_report, health, measure_normalization, preview, report, write_json
from docloom.sources import pdf
from docloom.sources.files import from_records, read_files, read_texts, settled, to_records, validate, watch_files
from docloom.sources.tables import Tables
from docloom.sources.topics import FolderTopic
from docloom.streaming.batching import MicroBatcher, microbatches

NOTES = "---\ntitle: Notes\nversion: 3\n---\n# Storage\n## Replication\nCopies may lag behind the primary. A failure can lose late writes.\n# Routing\nBalancers spread requests over servers. Health checks remove broken ones."


def test_files_to_answers(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    (box / "notes.md").write_text(NOTES)
    (box / "bad.exe").write_bytes(b"x")
    engine = Engine(spark, str(tmp_path / "engine"), least=5, most=200, threshold=0.0)
    engine.add_files(read_files(spark, str(box)), 0)
    engine.add_files(read_files(spark, str(box)), 0)
    found = {r.chunk_id: r for r in engine.index.read().collect()}
    doc = str(uuid.uuid5(uuid.NAMESPACE_URL, str(box / "notes.md")))
    assert sorted(found) == [f"{doc}:0", f"{doc}:1"]
    first = found[f"{doc}:0"]
    assert first.point_id == str(uuid.uuid5(uuid.NAMESPACE_URL, first.chunk_id)) and len(first.dense) == 384
    assert (first.doc_title, first.doc_version, first.source_uri, first.hierarchical_context) == ("Notes", "3", str(box / "notes.md"), ["Storage", "Replication"])
    assert first.text.startswith("[Storage -> Replication] Copies") and tuple(first.indices) == tuple(indexing.sparse_vector(first.text)[0])
    assert [r.reason for r in spark.read.parquet(str(tmp_path / "engine/dead-documents")).collect()] == ["unsupported extension '.exe'"]

    cases = spark.createDataFrame([("c1", "How do copies of the primary fail?", "r", "notes.md"), ("c2", "Who removes broken servers?", "r", "absent")], "id string, question string, reference_answer string, expected_source_uri_contains string")
    hits = engine.search(cases.select(F.col("id").alias("query_id"), "question"), k=1)
    assert {r.query_id: r.chunk_id for r in hits.collect()} == {"c1": f"{doc}:0", "c2": f"{doc}:1"}
    rows, totals = evaluate(cases, hits)
    assert {r.case_id: (r.retrieval_hit, r.citation_hit, r.faithfulness, r.cost_usd) for r in rows.collect()} == {"c1": (1.0, 1.0, None, None), "c2": (0.0, 0.0, None, None)}
    judge = lambda case, blocks, said: {"faithfulness": 1.0, "answer_relevance": 0.5, "context_precision": 0.0, "input_tokens": 3, "output_tokens": 2, "cost_usd": 0.5}
    model = lambda q, b: {"text": "t", "citations": [], "usage": {"input_tokens": 10, "output_tokens": 1, "cost_usd": 0.25}}
    rows, totals = evaluate(cases, hits, model, judge)
    out = evaluation_report(rows, totals, "v", True)
    assert out["metrics"]["input_tokens"] == 26 and out["metrics"]["cost_usd"] == 1.5 and out["metrics"]["citation_hit"] == 0.0 and out["case_count"] == 2
    shown = report(engine, spark.createDataFrame([(NOTES,)], "text string"), out, {"down": lambda: 1 / 0})
    assert not shown["healthy"] and shown["index"]["chunks"] == 2 and json.loads(write_json(shown, str(tmp_path / "a/b.json")))["index"]["documents"] == 1
    assert preview(engine.index.read(), width=10).where("length(preview) > 11").count() == 0

    # a shorter version: its stale chunk leaves; then the document goes
    (box / "notes.md").write_text(NOTES.split("# Routing")[0])
    engine.add_files(read_files(spark, str(box)), 1)
    assert [r.chunk_id for r in engine.index.read().collect()] == [f"{doc}:0"]
    assert [tuple(r) for r in engine.registry.read().collect()] == [(doc, f"{doc}:0", 2)]
    assert [r.chunk_id for r in engine.remove_documents(spark.createDataFrame([(doc,), ("unknown",)], "doc_id string"), 2).collect()] == [f"{doc}:0"]
    assert engine.index.read().count() == 0 and engine.registry.read().count() == 0
    assert engine.search(cases.select(F.col("id").alias("query_id"), "question")).count() == 0
    rows, _ = evaluate(cases, engine.search(cases.select(F.col("id").alias("query_id"), "question")))
    assert all(r.retrieval_hit == 0 for r in rows.collect())


def test_streams_guard_and_set_aside(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    (box / "notes.md").write_text(NOTES)
    short = Engine(spark, str(tmp_path / "short"), dim=7)
    assert short.stream(watch_files(spark, str(box)), str(tmp_path / "s1")).awaitTermination(120)
    refused = spark.read.parquet(str(tmp_path / "short/dead-chunks")).collect()
    assert refused and all("384 dimensions, 7 expected" in r.dlq_reason for r in refused) and short.index.read().count() == 0
    (box / "p.pdf").write_bytes(b"%PDF-1.4 /Type /Page %%EOF")
    # a file that cannot be read is set aside alone
    failing = Engine(spark, str(tmp_path / "failing"))
    assert failing.stream(watch_files(spark, str(box)), str(tmp_path / "s2")).awaitTermination(240)
    assert [r.reason for r in spark.read.parquet(str(tmp_path / "failing/dead-documents")).collect()] == ["PDF has no pages"]
    assert failing.index.read().count() > 0
    # files of a batch that fails as a whole wait; after six tries in all they are dead, with the reason; nothing sleeps
    now = [1000.0]
    broken = Engine(spark, str(tmp_path / "broken"), clock=lambda: now[0], no_such_bound=1)
    assert broken.stream(watch_files(spark, str(box)), str(tmp_path / "s3")).awaitTermination(240)
    waiting = {r.doc_id: (r.attempts, r.due) for r in broken.tables.reader("files").read().collect()}
    assert len(waiting) == 2 and all(n == 1 and 1000 <= due <= 1001 for n, due in waiting.values()) and broken.retry("early")["files"] in (0, 1, 2)
    for n in range(2, 7):
        now[0] += 61
        assert broken.retry(f"again-{n}")["files"] == 2
        waiting = broken.tables.reader("files").read().collect()
        assert all(r.attempts == n and now[0] <= r.due <= now[0] + min(60, 2 ** (n - 1)) for r in waiting) and len(waiting) == (2 if n < 6 else 0)
    dead = spark.read.parquet(str(tmp_path / "broken/dead-files")).collect()
    assert len(dead) == 2 and all("no_such_bound" in r.reason for r in dead)
    now[0] += 61
    assert broken.retry("late")["files"] == 0
    parsed = Engine(spark, str(tmp_path / "parsed"), pdf_pages=lambda content: ["One page.", None])
    parsed.add_files(read_files(spark, str(box)), 0)
    assert any(r.text == "One page." for r in parsed.index.read().collect())


def test_failed_embeddings_drop_their_own_chunks(spark):
    def embed(texts):
        if any("w20x" in t for t in texts):
            raise ValueError("no vector\nfor this")
        return [[1.0, 2.0]] * len(texts)

    chunks = spark.createDataFrame([(f"d:{i}", "d", f"w{i}x", [], 1, "1", None, "u") for i in range(40)], indexing.PAYLOAD).coalesce(1).sortWithinPartitions(F.substring("chunk_id", 3, 9).cast("int"))
    made = indexing.points(chunks, embed, 2).collect()
    assert {r.chunk_id for r in made if r.failed} == {f"d:{i}" for i in range(16, 32)} and {r.dropped for r in made} == {None, "embedding failed: no vector"}
    assert all((r.dense is None) == (r.dropped is not None) for r in made)


def test_failed_embeddings_are_tried_again(spark, tmp_path):
    """Six tries at full-jitter times, then the dead chunks; what works in between is indexed, what leaves its document is tried no more."""
    now, marks = [0.0], tmp_path / "works"

    def embed(texts):
        if not marks.exists() and any("late" in t for t in texts) or any("never" in t for t in texts):
            raise ValueError("down")
        return [[float(len(t)), 1.0] for t in texts]

    engine = Engine(spark, str(tmp_path / "engine"), embed=embed, dim=2, clock=lambda: now[0], least=1, most=50)
    docs = lambda *found: spark.createDataFrame([(i, "u", "text/plain", t) for i, t in found], "doc_id string, source_uri string, mime_type string, text string").repartition(4, "doc_id")
    # one document a call, for a call that fails fails for all of its chunks
    for i, said in enumerate(["good words", "late words", "never words", "never gone"]):
        done = engine.add_documents(docs((f"d{i}", said)), f"first-{i}")
        assert (done["upserted"], done["waiting"], done["dropped"]) == ((1, 0, 0) if i == 0 else (0, 1, 0))
    waiting = lambda: {r.parent_doc_id: (r.attempts, r.due) for r in engine.tables.reader("retries").read().collect()}
    first = waiting()
    assert set(first) == {"d1", "d2", "d3"} and all(n == 1 and 0 <= due <= 1 for n, due in first.values()) and len({due for _, due in first.values()}) == 3
    assert {r.parent_doc_id for r in engine.index.read().collect()} == {"d0"} and engine.registry.read().count() == 4
    engine.remove_documents(spark.createDataFrame([("d3",)], "doc_id string"), "gone")
    marks.write_text("")
    for n in range(2, 7):
        now[0] += 61
        engine.retry(f"again-{n}")
        assert waiting().get("d2", (n, 0))[0] == n
    assert waiting() == {} and {r.parent_doc_id for r in engine.index.read().collect()} == {"d0", "d1"}
    dead = spark.read.parquet(str(tmp_path / "engine/dead-chunks")).collect()
    assert [(r.parent_doc_id, r.dlq_reason) for r in dead] == [("d2", "embedding failed: down")]


def test_a_commit_that_fails_leaves_registry_and_index_alike(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "engine"), least=1, most=50)
    docs = lambda text: spark.createDataFrame([("a", "u", "text/plain", text)], "doc_id string, source_uri string, mime_type string, text string")
    engine.add_documents(docs("One. Two."), 0)
    chunks = lambda: (sorted(r.text for r in engine.index.read().collect()), sorted(r.version for r in engine.registry.read().collect()))
    before = chunks()
    write, calls = Tables._write, []

    def failing(self, *args):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("lost")
        return write(self, *args)

    monkeypatch.setattr(Tables, "_write", failing)
    with pytest.raises(OSError):
        engine.add_documents(docs("Other."), 1)
    assert chunks() == before
    monkeypatch.undo()
    engine.add_documents(docs("Other."), 1)
    assert chunks() == (["Other."], [2])


def test_chunks_through_a_topic(spark, tmp_path):
    topic = FolderTopic(spark, str(tmp_path / "topic"))
    engine = Engine(spark, str(tmp_path / "engine"), least=5, most=200, threshold=0.0)
    direct = Engine(spark, str(tmp_path / "direct"), least=5, most=200, threshold=0.0)
    docs = lambda text: spark.createDataFrame([("a", "u/a", "text/markdown", text), ("b", "u/b", "text/plain", "Plain words here.")], "doc_id string, source_uri string, mime_type string, text string")
    for number, text in enumerate([NOTES, NOTES.split("# Routing")[0]]):
        engine.publish_documents(docs(text), number, topic)
        done = direct.add_documents(docs(text), number)
        assert engine.embed_stream(topic, str(tmp_path / "state")).awaitTermination(120)
        rows = lambda e: sorted(map(str, e.index.read().collect()))
        assert rows(engine) == rows(direct) and sorted(map(str, engine.registry.read().collect())) == sorted(map(str, direct.registry.read().collect()))
        assert done["upserted"] == done["chunks"] == len(rows(direct)) and done["dropped"] == 0 and done["normalization"]["before_tokens"] > 0
    assert len(rows(engine)) == 2


def test_pdf_text_and_title(spark, tmp_path):
    page = zlib.compress(b"BT /F1 12 Tf 72 700 Td (Hello \\(PDF\\)) Tj 0 -14 Td [(wor) -20 (ld) -300 (two)] TJ ET")
    body = b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Type/Pages/Kids[3 0 R 5 0 R]/Count 2>>endobj 3 0 obj<</Type/Page/Parent 2 0 R/Contents 4 0 R>>endobj "
    body += b"4 0 obj<</Length %d/Filter/FlateDecode>>stream\n%s\nendstream endobj 5 0 obj<</Type/Page/Parent 2 0 R>>endobj 6 0 obj<</Title(A \\(b\\))>>endobj trailer<</Root 1 0 R/Info 6 0 R>>\n%%%%EOF" % (len(page), page)
    (tmp_path / "x.pdf").write_bytes(body)
    got = read_texts(validate(read_files(spark, str(tmp_path)))).first()
    assert (got.text, got.pdf_title, got.reason) == ("Hello (PDF)\nworld two\n\n", "A (b)", None)
    assert indexing.payloads(read_texts(validate(read_files(spark, str(tmp_path)))), least=1).first().doc_title == "A (b)"
    assert pdf.title(body.replace(b"/Title(A", b"/Titel(A")) is None
    with pytest.raises(ValueError):
        pdf.pages(b"%PDF-1.7 /Encrypt")


def test_settled_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("x")
    assert settled(read_files(spark, str(tmp_path)), 600.0).count() == 0
    assert settled(read_files(spark, str(tmp_path)), -600.0).count() == 1


def test_strict_utf8_and_records(spark, tmp_path):
    rows = spark.createDataFrame([("k", None, [1, 2])], "a string, b bigint, c array<int>")
    sent = to_records(rows, "a")
    assert sent.first().value == '{"a":"k","b":null,"c":[1,2]}'
    raw = sent.unionByName(spark.createDataFrame([("x", "{no")], "key string, value string"))
    got = from_records(raw, "a string, b bigint, c array<int>").collect()
    assert (got[0].a, got[0].c, got[0].bad) == ("k", [1, 2], None) and got[1].a is None and got[1].bad == "{no"
    (tmp_path / "x.md").write_bytes(b"\xff\xfe")
    with pytest.raises(PySparkException):
        read_texts(validate(read_files(spark, str(tmp_path)))).collect()


def test_usage_and_judge(spark):
    fields = "input_tokens bigint, output_tokens bigint, cache_creation_input_tokens bigint, cache_read_input_tokens bigint"
    df = spark.createDataFrame([(1, (100, 20, 0, None)), (2, (100, 20, 5, 0)), (3, None)], f"i int, r struct<{', '.join(':'.join(x.split()) for x in fields.split(', '))}>")
    got = {r.i: r.u for r in df.select("i", T.usage(F.col("r"), F.lit(3.0), F.lit(15.0)).alias("u")).collect()}
    assert got[1].cost_usd == pytest.approx(0.0006) and got[1].total_tokens == 120 and got[2].cost_usd is None and got[2].total_tokens == 125
    assert got[3].total_tokens == 0 and got[3].cost_usd is None
    said = lambda t: spark.createDataFrame([(t,)], "t string").select(T.judge_scores(F.col("t")).alias("s"))
    good = '```json\n{"faithfulness": 1, "answer_relevance": 0.5,\n "context_precision": 0}\n```\nBecause {x}'
    assert tuple(said(good).first().s) == (1.0, 0.5, 0.0)
    nested = 'So: {"why": {"a": [1, {"b": 2}]}, "faithfulness": 1, "answer_relevance": 0.5, "context_precision": 0} {"faithfulness": 9}'
    assert tuple(said(nested).first().s) == (1.0, 0.5, 0.0)
    for bad in ("no", '{"faithfulness": true, "answer_relevance": 0.5, "context_precision": 0}', '{"faithfulness": 1.1, "answer_relevance": 0.5, "context_precision": 0}', None):
        with pytest.raises(PySparkException):
            said(bad).collect()


def test_microbatches_equal_a_batcher(spark):
    events = spark.createDataFrame([(u, i, float(t)) for u, n in ((1, 50), (2, 1), (3, 7)) for i, t in enumerate(sorted((j * j * 13) % 97 for j in range(n)))] + [(None, 1, 1.0)], "user_id bigint, event_id bigint, t double")
    got = microbatches(events.withColumn("ts", F.timestamp_seconds("t")), size=4, seconds=9.0).collect()
    want = set()
    for u in (1, 2, 3):
        now = [0.0]
        held, out = MicroBatcher(4, 9.0, lambda: now[0]), []
        for r in sorted((r.t, r.event_id) for r in events.where(f"user_id = {u}").collect()):
            now[0] = r[0]
            held.add(r[1])
            if held.ready():
                out.append(held.flush())
        out += [held.flush()] if held.items else []
        want |= {(u, k, len(b), b[0], b[-1]) for k, b in enumerate(out)}
    assert {tuple(r) for r in got} == want
    named = events.where("user_id = 3").select(F.lit("u").alias("user_id"), F.concat(F.lit("e"), "event_id").alias("event_id"), F.timestamp_seconds("t").alias("ts"))
    assert {r.user_id for r in microbatches(named, size=4, seconds=9.0).collect()} == {"u"}


def test_health_and_measure(spark):
    assert health({"a": lambda: "ok", "b": lambda: 1 / 0}) == [{"name": "a", "ok": True, "detail": "ok"}, {"name": "b", "ok": False, "detail": "division by zero"}]
    row = measure_normalization(spark.createDataFrame([("Page 1 of 2\na b",), (None,)], "text string")).first()
    assert (row.before_tokens, row.after_tokens, row.target_met) == (6, 2, True)
