"""The command line: files to an engine's folder, questions to answers, question sets to metrics.

Exit codes: 0 done, 1 a service is down or a gate is missed, 2 the command could not run. Results go to standard output,
messages to standard error.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import uuid5
from docloom.operators import evaluation, indexing, retrieval
from docloom.plans.pipelines import Engine, evaluate, evaluation_report, health, measure_normalization, preview, report, write_json
from docloom.session import local_session, new_path
from docloom.sources.files import load_questions, read_files, read_texts, route, settled, validate, watch_files
from docloom.sources.settled import watch_settled
from docloom.sources.topics import FolderTopic


def _named(path: str | None) -> Callable | None:
    """A callable given as module:name."""
    if not path:
        return None
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def _engine(spark: SparkSession, args: argparse.Namespace) -> Engine:
    return Engine(spark, args.engine, **({"embed": _named(args.embed)} if args.embed else {}))


def _next(engine: Engine) -> str:
    """A name of a batch of its own."""
    return f"run-{engine.tables.view().version + 1}"


def check_health(spark: SparkSession, args: argparse.Namespace) -> int:
    engine = _engine(spark, args)
    probes = {
        "spark": lambda: f"version {spark.version}, {spark.sparkContext.defaultParallelism} cores",
        "shared folder": lambda: new_path(spark, "probe"),
        "registry": lambda: f"{engine.registry.read().count()} chunk(s)",
        "index": lambda: f"{engine.index.read().count()} point(s)",
    }
    found = health(probes)
    for row in found:
        print(f"{row['name']:<14} {'up' if row['ok'] else 'down':<5} {row['detail']}")
    return 0 if all(r["ok"] for r in found) else 1


def ingest(spark: SparkSession, args: argparse.Namespace) -> int:
    engine = _engine(spark, args)
    if args.action == "retry":
        print(json.dumps(engine.retry(_next(engine)), sort_keys=True))
    elif args.action == "process":
        print(json.dumps(engine.add_files(read_files(spark, args.path), _next(engine)), sort_keys=True))
    else:
        trigger = {"availableNow": True} if args.once else {"processingTime": "2 seconds"}
        # files of a file system that is not mounted come by moves, which are atomic
        files = watch_files(spark, args.path) if "://" in args.path else watch_settled(spark, args.path, args.settle_seconds)
        engine.stream(files, f"{engine.path}/watched", **trigger).awaitTermination()
    return 0


def chunk(spark: SparkSession, args: argparse.Namespace) -> int:
    """Chunks of files, shown, or with --topic sent to a topic."""
    texts = read_texts(route(validate(settled(read_files(spark, args.path), 0.0)))[0]).where("reason IS NULL").drop("reason")
    if args.topic:
        engine = _engine(spark, args)
        engine.publish_documents(texts, _next(engine), FolderTopic(spark, args.topic))
    else:
        preview(indexing.payloads(texts)).orderBy("chunk_id").show(200, truncate=False)
    return 0


def embed(spark: SparkSession, args: argparse.Namespace) -> int:
    engine = _engine(spark, args)
    trigger = {"availableNow": True} if args.once else {"processingTime": "2 seconds"}
    engine.embed_stream(FolderTopic(spark, args.topic), f"{engine.path}/embedded", **trigger).awaitTermination()
    return 0


def _ask(engine: Engine, question: str, k: int, model: Callable | None) -> dict:
    asked = engine.spark.createDataFrame([("q", question)], "query_id string, question string")
    found = retrieval.contexts(engine.search(asked, k), "query_id").first()  # one question, k chunks
    return retrieval.answer(question, [b.asDict() for b in found["blocks"]] if found else [], model)


def query(spark: SparkSession, args: argparse.Namespace) -> int:
    said = _ask(_engine(spark, args), args.question, args.top_k, _named(args.model))
    print(said["text"])
    for n, c in enumerate(said["citations"], 1):
        print(f"[{n}] {c['title']} ({c['source_uri']}): {c['cited_text'][:200]}")
    return 0


def registry(spark: SparkSession, args: argparse.Namespace) -> int:
    engine = _engine(spark, args)
    ids = spark.createDataFrame([(args.path,)], "path string").select(uuid5(F.col("path")).alias("doc_id"))
    gone = [r["chunk_id"] for r in engine.remove_documents(ids, _next(engine)).orderBy("chunk_id").collect()]  # of one document
    print(f"{len(gone)} chunk(s) of {args.path} removed" if gone else f"no chunks of {args.path} are registered")
    return 0


def _evaluated(spark: SparkSession, engine: Engine, dataset: str, model: Callable | None, judge: Callable | None) -> dict:
    cases = load_questions(spark, dataset)
    version = cases.select("dataset_version").first()[0]
    hits = engine.search(cases.select(F.col("id").alias("query_id"), "question"))
    return evaluation_report(*evaluate(cases, hits, model, judge), version, judge is not None)


def run_evaluation(spark: SparkSession, args: argparse.Namespace) -> int:
    judge = None if args.skip_judge else _named(args.judge)
    found = _evaluated(spark, _engine(spark, args), args.dataset, _named(args.model), judge)
    _write(found, args.output)
    if args.min_retrieval_hit_rate is not None:
        evaluation.gate(found["metrics"]["retrieval_hit"], args.min_retrieval_hit_rate)
    return 0


def _write(document: dict, output: str | None) -> None:
    text = write_json(document, output)
    print(f"wrote {output}" if output else text, end="\n" if output else "")


def optimize(spark: SparkSession, args: argparse.Namespace) -> int:
    texts = spark.read.text(args.path, wholetext=True).withColumnRenamed("value", "text")
    _write(measure_normalization(texts).first().asDict(), None)
    return 0


def demo(spark: SparkSession, args: argparse.Namespace) -> int:
    """A file indexed, its set's first question asked, the set evaluated: one report."""
    engine = _engine(spark, args)
    files = read_files(spark, args.document)
    checked = validate(files).select("ok", "reason").first()
    if checked is None or not checked["ok"]:
        raise RuntimeError(f"the document is not valid: {checked['reason'] if checked else 'not found'}")
    indexed = engine.add_files(files, _next(engine))
    question = load_questions(spark, args.dataset).orderBy("id").first()["question"]
    said = _ask(engine, question, args.top_k, _named(args.model))
    asked = {"question": question, "answer": said["text"], "citations": len(said["citations"]), "usage": said["usage"]}
    judged = _evaluated(spark, engine, args.dataset, _named(args.model), _named(args.judge))
    _write({"schema_version": 1, "document": args.document, "indexing": indexed, "query": asked, "evaluation": judged}, args.output)
    return 0


def dashboard(spark: SparkSession, args: argparse.Namespace) -> int:
    engine = _engine(spark, args)
    evaluated = json.loads(spark.read.text(args.results, wholetext=True).first()[0]) if args.results else None
    _write(report(engine, engine.index.read(), evaluated), args.output)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="docloom", description=__doc__)
    top.add_argument("--cpus", default="*", help="cores of the local session, where none is running")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, *words: str, **options) -> argparse.ArgumentParser:
        one = commands.add_parser(name, help=(run.__doc__ or name).split("\n")[0])
        one.set_defaults(run=run)
        one.add_argument("--engine", default="docloom-engine", help="folder of the registry and the index")
        one.add_argument("--embed", help="embedder as module:name")
        for word in words:
            one.add_argument(word)
        for option, about in options.items():
            one.add_argument(f"--{option.replace('_', '-')}", **about)
        return one

    models = {"model": {"help": "answering model as module:name"}, "judge": {"help": "judge as module:name"}}
    output, once = {"output": {"help": "file for the JSON result"}}, {"once": {"action": "store_true", "help": "stop when all there is has been handled"}}
    command("health", check_health)
    one = command("ingest", ingest, **once)
    one.add_argument("action", choices=["process", "watch", "retry"])
    one.add_argument("path", nargs="?", help="folder of files; not used by retry")
    one.add_argument("--settle-seconds", type=float, default=1.0, help="how long a watched file must have stayed as it is")
    command("chunk", chunk, "path", topic={"help": "folder of the topic that chunks go to"})
    command("embed", embed, "topic", **once)
    command("query", query, "question", top_k={"type": int, "default": retrieval.TOP_K}, model=models["model"])
    one = command("registry", registry)
    one.add_argument("action", choices=["tombstone"])
    one.add_argument("path", help="the document's path or URI as it was ingested")
    rate = {"type": float, "help": "exit with 1 below this rate"}
    command("eval", run_evaluation, "dataset", **models, **output, skip_judge={"action": "store_true"}, min_retrieval_hit_rate=rate)
    command("optimize", optimize, "path")
    command("demo", demo, "document", "dataset", **models, **output, top_k={"type": int, "default": retrieval.TOP_K})
    command("dashboard", dashboard, results={"help": "an evaluation's JSON result"}, **output)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        spark = SparkSession.getActiveSession() or local_session(args.cpus)
        return args.run(spark, args)
    except evaluation.GateMissed as missed:
        print(missed, file=sys.stderr)
        return 1
    except Exception as error:
        print(f"{args.command} could not run: {str(error).splitlines()[0] if str(error) else type(error).__name__}", file=sys.stderr)
        return 2
