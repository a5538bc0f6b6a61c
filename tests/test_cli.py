"""The command line, each command on small files, with its exit codes."""

import json

import pytest

from docloom.cli import main

NOTES = "---\ntitle: Notes\n---\n# Storage\nCopies may lag behind the primary. A failure can lose late writes.\n# Routing\nBalancers spread requests over servers."


def judge(case, blocks, said):
    return {"faithfulness": 1.0, "answer_relevance": 1.0, "context_precision": 1.0}


@pytest.fixture(scope="module")
def box(tmp_path_factory):
    box = tmp_path_factory.mktemp("cli")
    (box / "in").mkdir()
    (box / "in/notes.md").write_text(NOTES)
    case = {"id": "1", "question": "Who spreads requests?", "reference_answer": "balancers", "expected_source_uri_contains": "notes.md"}
    (box / "qa.json").write_text(json.dumps({"schema_version": 1, "dataset_version": "v", "cases": [case]}))
    return box


def test_commands(spark, box, capsys):
    engine = ["--engine", str(box / "engine")]
    run = lambda *words: (main([*words, *engine]), capsys.readouterr())
    code, said = run("ingest", "process", str(box / "in"))
    assert code == 0 and json.loads(said.out)["upserted"] == json.loads(said.out)["chunks"] > 0
    code, said = run("query", "Who spreads requests?")
    assert code == 0 and "Balancers" in said.out and "notes.md" in said.out
    assert run("eval", str(box / "qa.json"), "--min-retrieval-hit-rate", "1.0", "--output", str(box / "out/eval.json"))[0] == 0
    assert json.loads((box / "out/eval.json").read_text())["metrics"]["retrieval_hit"] == 1.0
    assert run("eval", str(box / "qa.json"), "--judge", "tests.test_cli:judge", "--min-retrieval-hit-rate", "1.1")[0] == 1
    code, said = run("eval", str(box / "absent.json"))
    assert code == 2 and "could not run" in said.err
    code, said = run("dashboard", "--results", str(box / "out/eval.json"))
    assert code == 0 and json.loads(said.out)["evaluation"]["case_count"] == 1 and json.loads(said.out)["healthy"]
    assert run("health")[0] == 0
    code, said = run("registry", "tombstone", str(box / "in/notes.md"))
    assert code == 0 and "chunk(s)" in said.out and "removed" in said.out
    assert "no chunks" in run("registry", "tombstone", str(box / "in/notes.md"))[1].out
    assert "No relevant context" in run("query", "Who?")[1].out


def test_topic_commands_and_demo(spark, box, capsys):
    engine, topic = ["--engine", str(box / "second")], str(box / "topic")
    assert main(["chunk", str(box / "in"), *engine]) == 0 and "Storage" in capsys.readouterr().out
    assert main(["chunk", str(box / "in"), "--topic", topic, *engine]) == 0 and main(["embed", topic, "--once", *engine]) == 0
    assert main(["query", "Who spreads requests?", *engine]) == 0 and "Balancers" in capsys.readouterr().out
    assert main(["ingest", "watch", str(box / "in"), "--once", "--engine", str(box / "third")]) == 0
    assert main(["query", "What may lag?", "--engine", str(box / "third")]) == 0 and "Copies" in capsys.readouterr().out
    assert main(["demo", str(box / "in/notes.md"), str(box / "qa.json"), "--engine", str(box / "fourth")]) == 0
    shown = json.loads(capsys.readouterr().out)
    assert shown["indexing"]["dropped"] == 0 and shown["query"]["citations"] == 1 and shown["evaluation"]["metrics"]["retrieval_hit"] == 1.0
    assert main(["demo", str(box / "qa.json"), str(box / "qa.json"), "--engine", str(box / "fourth")]) == 2
    (box / "t.txt").write_text("Page 1 of 2\na b")
    assert main(["optimize", str(box / "t.txt")]) == 0 and json.loads(capsys.readouterr().out)["removed_tokens"] == 4


def test_health_says_what_is_down(spark, box, capsys):
    (box / "broken/tables/versions").mkdir(parents=True)
    (box / "broken/tables/versions/000000000001.json").write_text("no json")
    assert main(["health", "--engine", str(box / "broken")]) == 1 and "down" in capsys.readouterr().out
