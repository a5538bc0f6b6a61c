"""Files to index, index to answers, answers to metrics: the operators put together, in batches and as streams."""

from __future__ import annotations

import json
import threading
import time
import zlib
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.functions.text import approx_tokens, normalize_text
from docloom.operators import evaluation, indexing, registry, retrieval
from docloom.operators.chunking import hashed_vectors
from docloom.session import scratch, small, store
from docloom.sources import pdf
from docloom.sources.files import from_records, read_files, read_texts, route, to_records, validate
from docloom.sources.tables import Keyed, Tables
from docloom.sources.topics import Topic
from docloom.streaming.batching import RETRIES, scheduled
from docloom.streaming.delivery import Deliveries

LINEAGE = "doc_id string, chunk_id string, version bigint"
#: Of what is to be tried again: how often it has failed, when its next try is due (epoch seconds) and why it failed.
WAITING = "attempts int, due double, reason string"
JUDGE = ["faithfulness", "answer_relevance", "context_precision"]
#: Cases of a report, which the driver holds.
CASES = 100_000
METRICS = ["retrieval_hit", "reciprocal_rank", "source_precision", "citation_hit", *JUDGE]


def _batch(kind: str, checkpoint: str, number: int) -> str:
    """A name for a stream's batch that no other stream's has."""
    return f"{kind}-{zlib.crc32(checkpoint.encode()):08x}-{number}"


class Engine:
    """Tables under one folder that change in one commit a batch (the registry of chunks, the index, and what is to be tried again), and what was turned down (dead).

    Batches are named by the caller: one that is run again at once replaces itself. Commits of one process take turns. `clock` tells the time in seconds.
    """

    def __init__(self, spark: SparkSession, path: str, embed: Callable = hashed_vectors, dim: int = 384, pdf_pages: Callable | None = pdf.pages, retries: int = RETRIES, clock: Callable[[], float] = time.time, **bounds):
        self.spark, self.path = spark, path.rstrip("/")
        self.embed, self.dim, self.pdf_pages, self.bounds, self.retries, self.clock = embed, dim, pdf_pages, bounds, retries, clock
        kinds = {"registry": Keyed(LINEAGE, "chunk_id", "doc_id"), "index": Keyed(indexing.POINT, "chunk_id", "parent_doc_id"), "retries": Keyed(f"{indexing.PAYLOAD}, {WAITING}", "chunk_id", "parent_doc_id"), "files": Keyed(f"doc_id string, source_uri string, {WAITING}", "doc_id")}
        self.tables = Tables(spark, f"{self.path}/tables", kinds)
        self.registry, self.index = self.tables.reader("registry"), self.tables.reader("index")
        self.deliveries = Deliveries(spark, f"{self.path}/deliveries")
        self._turn = threading.RLock()

    def _dead(self, rows: DataFrame, kind: str, batch: str | int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/dead-{kind}/batch={batch}")

    def _chunked(self, docs: DataFrame, batch: str | int) -> tuple[DataFrame, DataFrame]:
        """Chunk payloads of documents, and what they change in the registry."""
        chunks = store(indexing.payloads(docs, **self.bounds), "chunks")
        now = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(None).cast("string").alias("chunk_id"))
        now = now.unionByName(chunks.select(F.col("parent_doc_id").alias("doc_id"), "chunk_id"))
        touched = now.where("chunk_id IS NULL").select("doc_id")
        return chunks, store(registry.diff(self.registry.read(batch, touched), now), "changes")

    def _indexed(self, chunks: DataFrame, gone: DataFrame, batch: str | int) -> tuple[dict[str, tuple], dict]:
        """Changes that put chunks (which may have had attempts before) into the index and take those in gone (chunk_id, parent_doc_id) out; and what was done, as counts.

        A chunk whose embedding fails is to be tried again at a later time, six times in all; then, or where its vector has another length, it is dead.
        """
        again = "attempts" in chunks.columns
        tried = chunks if again else chunks.withColumn("attempts", F.lit(0))
        # what has failed before is embedded one by one: what cannot be embedded keeps no other back
        made = store(indexing.points(tried, self.embed, self.dim, 1 if again else indexing.SIZE, counted=True), "points")
        raw = made.where("dropped IS NOT NULL").withColumn("text", F.col("raw_text"))
        again, lost = scheduled(raw.where("failed IS NOT NULL"), "chunk_id", self.clock(), self.retries)
        refused = raw.where("failed IS NULL AND dropped IS NOT NULL").unionByName(lost)
        names = [c for c in chunks.columns if c not in ("attempts", "due", "reason")]
        self._dead(refused.select(*names, F.col("dropped").alias("dlq_reason")), "chunks", batch)
        # an older point of a chunk that has none now must not stay behind it, nor an older try
        owner = ["chunk_id", "parent_doc_id"]
        without = made.where("dropped IS NOT NULL").select(*owner)
        settled = made.select(*owner).unionByName(gone.select(*owner))
        changes = {"index": (made.where("dropped IS NULL"), gone.unionByName(without)), "retries": (again.withColumn("reason", F.col("failed")), settled)}
        n, dropped, waiting = made.agg(F.count(F.lit(1)), F.count("dropped"), F.count(F.when(F.col("failed").isNotNull() & (F.col("attempts") < self.retries), 1))).first()
        return changes, {"chunks": n, "upserted": n - dropped, "dropped": dropped - waiting, "waiting": waiting, "normalization": evaluation.normalization_report(made, "tokens_before", "tokens_after").first().asDict()}

    def add_documents(self, docs: DataFrame, batch: str | int, also: dict[str, tuple] | None = None) -> dict:
        """Brings documents (doc_id, source_uri, mime_type, text) in as one batch, one row a document; returns counts.

        Chunks that a document no longer has leave registry and index in the same commit, and so do they all or none. Points whose vector has another
        length go to the dead chunks with their raw text, and so do those whose embedding has failed too often. A batch that is run again gives the same
        tables. `also` are changes of other tables to go with the commit.
        """
        with self._turn, scratch(self.spark):
            chunks, changes = self._chunked(docs, batch)
            gone = changes.where("action = 'delete'")
            put, done = self._indexed(chunks, gone.select("chunk_id", F.col("doc_id").alias("parent_doc_id")), batch)
            self.tables.commit(batch, {**put, "registry": (changes.where("action <> 'delete'"), gone), **(also or {})})
            return done

    def retry(self, batch: str | int, at_once: int = 10_000) -> dict:
        """Tries again what is due, the longest due first: chunks whose embedding failed, and files of batches that failed; returns counts."""
        with self._turn, scratch(self.spark):
            view, now = self.tables.view(batch), self.clock()
            ready = lambda t: store(view.read(t).where(F.col("due") <= now).orderBy("due").limit(at_once), t)
            chunks, files = ready("retries"), ready("files")
            done = {"chunks": 0, "files": files.count()}
            if chunks.count():
                put, counts = self._indexed(chunks.drop("due", "reason"), chunks.select("chunk_id", "parent_doc_id").limit(0), f"{batch}-chunks")
                self.tables.commit(f"{batch}-chunks", put)
                done = {**done, **counts}
            if done["files"]:
                self._try_files(files.select("doc_id", "source_uri", "attempts"), f"{batch}-files")
            return done

    def _try_files(self, files: DataFrame, batch: str) -> None:
        """Adds files by their places; if that fails as a whole they wait for another try, or are dead after the last one."""
        places = [r["source_uri"] for r in files.select("source_uri").collect()]  # as many as are tried at once
        try:
            self.add_files(read_files(self.spark, places), batch, tried=files)
        except Exception as error:
            self._failed(files, error, batch)

    def _failed(self, files: DataFrame, error: Exception, batch: str | int) -> None:
        reason = str(error).split("\n")[0]
        again, lost = scheduled(files.withColumn("reason", F.lit(reason)), "doc_id", self.clock(), self.retries)
        self._dead(lost.select("doc_id", "source_uri", "reason"), "files", batch)
        self.tables.commit(batch, {"files": (again, files.select("doc_id"))})

    def publish_documents(self, docs: DataFrame, batch: str | int, topic: Topic) -> None:
        """As add_documents, but chunks go to a topic for others to embed: a record a chunk, without a value for chunks that go.

        Topics number their batches by the version of the tables, so a batch that is run again writes its segment again."""
        with self._turn, scratch(self.spark):
            chunks, changes = self._chunked(docs, batch)
            gone = changes.where("action = 'delete'").select(F.concat_ws("\n", "doc_id", "chunk_id").alias("key"), F.lit(None).cast("string").alias("value"))
            named = chunks.withColumn("key_", F.concat_ws("\n", "parent_doc_id", "chunk_id"))
            version = self.tables.view(batch).version
            self.deliveries.send(to_records(named, "key_").unionByName(gone), batch, lambda records: topic.write(records, version))
            self.tables.commit(batch, {"registry": (changes.where("action <> 'delete'"), changes.where("action = 'delete'"))})

    def embed_records(self, records: DataFrame, batch: str | int) -> dict:
        """Brings a batch of chunk records in; of records of one key the last in `at` holds, where the topic tells an order."""
        order = F.struct("at", "value") if "at" in records.columns else F.struct("value")
        last = records.groupBy("key").agg(F.max_by("value", order).alias("value"))
        key = F.split("key", "\n")
        put = from_records(last.where("value IS NOT NULL"), indexing.PAYLOAD).where("bad IS NULL").drop("bad")
        gone = last.where("value IS NULL").select(key[1].alias("chunk_id"), key[0].alias("parent_doc_id"))
        with self._turn, scratch(self.spark):
            changes, done = self._indexed(store(put, "received"), store(gone, "gone"), batch)
            self.tables.commit(batch, changes)
            return done

    def embed_stream(self, topic: Topic, checkpoint: str, **trigger) -> StreamingQuery:
        """Embeds a topic's records as they come, batch by batch; offsets are committed when a batch is in."""
        run = topic.stream().writeStream.foreachBatch(lambda batch, number: self.embed_records(batch, _batch("chunks", checkpoint, number)) and None)
        return run.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def add_files(self, files: DataFrame, batch: str | int, tried: DataFrame | None = None) -> dict:
        """Validates and adds files; those turned down, and those that cannot be read, go to the dead documents with their reasons. `tried` (doc_id): files that wait no longer."""
        good, bad = route(validate(files, pdf_pages=self.pdf_pages))
        texts = store(read_texts(good, self.pdf_pages), "texts")
        names = ["doc_id", "source_uri", "mime_type", "size_bytes", "timestamp", "reason"]
        bad = bad.select(*names[:3], F.col("length").alias("size_bytes"), F.col("modificationTime").cast("double").alias("timestamp"), "reason")
        self._dead(bad.unionByName(texts.where("reason IS NOT NULL").select(*names)), "documents", batch)
        also = {"files": (self.spark.createDataFrame([], self.tables.kinds["files"].schema), tried.select("doc_id"))} if tried is not None else None
        return self.add_documents(texts.where("reason IS NULL").drop("reason"), batch, also)

    def remove_documents(self, doc_ids: DataFrame, batch: str | int) -> DataFrame:
        """Tombstones: all chunks of the documents leave; returns their ids (none for unknown documents)."""
        with self._turn:
            wanted = doc_ids.select("doc_id").distinct()
            gone = store(registry.tombstone(self.registry.read(batch, wanted), wanted)[1], "tombstones")
            owned = gone.withColumnRenamed("doc_id", "parent_doc_id")
            none = lambda t: self.spark.createDataFrame([], self.tables.kinds[t].schema)
            self.tables.commit(batch, {"index": (none("index"), owned), "retries": (none("retries"), owned), "registry": (none("registry"), gone)})
            return gone

    def stream(self, files: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Adds a stream of files batch by batch, after what is due for another try. Files of a batch that fails wait for later batches; after the last try they are dead, with the reason."""

        def write(batch: DataFrame, number: int) -> None:
            with self._turn:
                name = _batch("files", checkpoint, number)
                self.retry(f"{name}-due")
                try:
                    self.add_files(batch, name)
                except Exception as error:
                    known = validate(batch).select("doc_id", "source_uri", F.lit(0).alias("attempts"))
                    self._failed(store(known, "failed"), error, name)

        return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def retry_stream(self, checkpoint: str, seconds: float = 1.0) -> StreamingQuery:
        """Tries again what is due, every so many seconds, for times in which no files come."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        run = ticks.writeStream.foreachBatch(lambda _, number: self.retry(_batch("retry", checkpoint, number)) and None)
        return run.option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()

    def search(self, questions: DataFrame, k: int = retrieval.TOP_K, prefetch: int = retrieval.PREFETCH) -> DataFrame:
        """The best k chunks of each question (query_id, question) with their payloads, score and rank, all from one state of the index, of which each side reads its own columns."""
        view, embed = self.tables.view(), self.embed
        index = view.read("index")

        def dense(texts: pd.Series) -> pd.Series:
            return pd.Series([[float(x) for x in v] for v in embed(list(texts))] if len(texts) else [], dtype=object)

        vectors = questions.select("query_id", F.pandas_udf(dense, "array<double>")("question").alias("vector"))
        rankings = [
            retrieval.dense_topk(vectors, index.select("chunk_id", F.col("dense").alias("vector")), "query_id", "chunk_id", prefetch),
            retrieval.sparse_topk(retrieval.term_vectors(questions, "query_id", "question"), index.select("chunk_id", "indices", "values"), "query_id", "chunk_id", prefetch),
        ]
        best = retrieval.rrf(rankings, "query_id", "chunk_id", k)
        return index.drop("dense", "indices", "values", "point_id").join(small(best), "chunk_id")


def evaluate(cases: DataFrame, hits: DataFrame, model: Callable | None = None, judge: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """One row a case (id, question, reference_answer, expected_source_uri_contains), and their totals, from search()'s hits.

    model and judge are plain callables run on executors: model(question, blocks) as for answer(); judge(case, blocks,
    answer) gives the three scores, input_tokens, output_tokens and cost_usd. Without a judge scores and cost are null.
    """
    keyed = cases.withColumnRenamed("id", "case_id")
    found = hits.withColumnRenamed("query_id", "case_id")
    blocks = retrieval.contexts(found, "case_id")
    uris = found.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("chunk_id", "source_uri"))).alias("uris"))
    asked = keyed.join(blocks, "case_id", "left").join(uris, "case_id", "left").select("case_id", "question", "reference_answer", F.to_json("blocks").alias("blocks"), F.to_json("uris").alias("uris"))

    def run(batches):
        for batch in batches:
            rows = []
            for case in batch.to_dict("records"):
                ranked = json.loads(case["blocks"]) if case["blocks"] else []
                said = retrieval.answer(case["question"], ranked, model)
                uris = json.loads(case["uris"]) if case["uris"] else {}
                scores = judge(case, ranked, said) if judge else {}
                used = [said["usage"] or {}, scores]
                costs = [u.get("cost_usd") for u in used]
                rows.append(
                    (case["case_id"], sorted({uris[c["chunk_id"]] for c in said["citations"] if uris.get(c["chunk_id"]) is not None}), *[scores.get(n) for n in JUDGE])
                    + tuple(sum(u.get(n) or 0 for u in used) for n in ("input_tokens", "output_tokens"))
                    + (sum(costs) if None not in costs else None,)
                )
            out = pd.DataFrame(rows, columns=["case_id", "cited", *JUDGE, "input_tokens", "output_tokens", "cost_usd"])
            yield out.astype({n: "float64" for n in (*JUDGE, "cost_usd")}).replace({float("nan"): None})

    answered = store(asked.mapInPandas(run, f"case_id string, cited array<string>, {', '.join(f'{n} double' for n in JUDGE)}, input_tokens bigint, output_tokens bigint, cost_usd double"), "answered")
    expected = keyed.select("case_id", F.col("expected_source_uri_contains").alias("expected"))
    measured = evaluation.case_metrics(expected, found.select("case_id", "rank", "source_uri"), answered.select("case_id", F.explode("cited").alias("source_uri")))
    rows = measured.join(answered.drop("cited"), "case_id")
    return rows, evaluation.totals(rows, METRICS, ["input_tokens", "output_tokens"], "cost_usd")


def evaluation_report(rows: DataFrame, totals: DataFrame, dataset_version: str, judged: bool) -> dict:
    """The evaluation as one JSON document; a question set is a list of at most CASES cases, more raise."""
    metrics = totals.first().asDict()
    count = metrics.pop("case_count")
    if count > CASES:
        raise ValueError(f"a report holds at most {CASES} cases; write the {count} rows as a table")
    cases = [r.asDict() for r in rows.orderBy("case_id").collect()]
    return {"schema_version": 2, "dataset_version": dataset_version, "case_count": count, "judge_enabled": judged, "metrics": metrics, "cases": cases}


def measure_normalization(texts: DataFrame, text: str = "text", target: float = 0.15) -> DataFrame:
    counted = texts.select(approx_tokens(F.col(text)).alias("before"), approx_tokens(normalize_text(F.col(text))).alias("after"))
    return evaluation.normalization_report(counted, "before", "after", target)


def health(checks: dict[str, Callable[[], str]]) -> list[dict]:
    """Each probe's detail, or the error it raised; one failing does not stop the others."""
    out = []
    for name, check in checks.items():
        try:
            out.append({"name": name, "ok": True, "detail": check()})
        except Exception as error:
            out.append({"name": name, "ok": False, "detail": str(error).split("\n")[0]})
    return out


def report(engine: Engine, texts: DataFrame, evaluated: dict | None = None, checks: dict[str, Callable[[], str]] | None = None) -> dict:
    """State of an engine: services, sizes, the last evaluation and what normalization takes off the texts."""
    services = health({"spark": lambda: engine.spark.version, **(checks or {})})
    index = engine.index.read()
    sizes = index.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("parent_doc_id").alias("documents"), F.sum("token_count").alias("tokens")).first().asDict()
    return {"services": services, "healthy": all(s["ok"] for s in services), "index": sizes, "evaluation": evaluated, "normalization": measure_normalization(texts).first().asDict()}


def write_json(document: dict, path: str | None = None) -> str:
    """Indented JSON with sorted keys, to a file (its folder is made) if a path is given."""
    text = json.dumps(document, indent=2, sort_keys=True, default=str) + "\n"
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8")
    return text


def preview(chunks: DataFrame, context: str = "hierarchical_context", width: int = 120) -> DataFrame:
    """Chunks for reading: the section path and the first characters on one line."""
    flat = F.regexp_replace("text", r"\s+", " ")
    cut = F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width), F.lit("…"))).otherwise(flat)
    return chunks.select("chunk_id", F.array_join(F.filter(context, lambda c: c != ""), " > ").alias("section"), "token_count", cut.alias("preview"))
