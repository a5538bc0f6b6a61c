"""Extractive answers: places of sentences, choice by marginal relevance, citations and cover."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import extractive, retrieval

BLOCKS = ["  Copies lag behind the primary. They may lose late writes!\nIs that so? (Yes.)", "Balancers spread requests. Copies lag behind the primary.", ""]


def test_spans_are_the_texts_sentences():
    rng = random.Random(1)
    texts = [*BLOCKS, *("".join(rng.choice(["Ab", "c.", "!", "? ", " ", "\n", "9", '"Q', "é"]) for _ in range(rng.randrange(30))) for _ in range(300))]
    for text in texts:
        spans = extractive.sentence_spans(text)
        assert all(text[a:b] == text[a:b].strip() != "" for a, b in spans) and "".join(text[a:b] for a, b in spans).split() == [*"".join(text[a:b] for a, b in spans).split()]
        assert "".join("".join(text[a:b] for a, b in spans).split()) == "".join(text.split())
    assert [BLOCKS[0][a:b] for a, b in extractive.sentence_spans(BLOCKS[0])] == ["Copies lag behind the primary.", "They may lose late writes!", "Is that so?", "(Yes.)"]


def test_spans_equal_the_sentences_of_columns(spark):
    from docloom.functions.text import sentences

    df = spark.createDataFrame([(i, t) for i, t in enumerate(BLOCKS)], "i int, t string")
    for r in df.select("i", sentences(F.col("t")).alias("s")).collect():
        assert r.s == [BLOCKS[r.i][a:b] for a, b in extractive.sentence_spans(BLOCKS[r.i])]


def test_what_repeats_what_is_said_comes_last():
    chosen = extractive.choose("Do copies of the primary lose writes?", BLOCKS, balance=0.5)
    said = [BLOCKS[i][a:b] for i, a, b, _ in chosen]
    assert said[0].startswith("Copies lag") and said[1] == "They may lose late writes!" and chosen[0][0] == 0
    assert [c[3] for c in extractive.choose("copies", BLOCKS, balance=1.0)][:2] == pytest.approx([chosen_ := extractive.choose("copies", BLOCKS, 1)[0][3]] * 2) and chosen_ > 0
    assert extractive.choose("nothing known", BLOCKS) == [] and extractive.choose("x", []) == []


def test_answers_cite_their_places():
    blocks = [{"text": t, "chunk_id": f"c:{i}", "title": "T", "source_uri": "u"} for i, t in enumerate(BLOCKS)]
    said = retrieval.answer("Do copies lose writes?", blocks, extractive.extract)
    assert said["citations"] and all(BLOCKS[int(c["chunk_id"][2:])][c["start"] : c["end"]] == c["cited_text"] and c["cited_text"] in said["text"] for c in said["citations"])
    assert retrieval.answer("zzz", blocks, extractive.extract) == {"text": "The context does not say.", "citations": [], "usage": None}


def test_cited_sentences_and_cover(spark):
    questions = spark.createDataFrame([("q", "Do copies lose writes?"), ("none", "zzz"), ("bare", None), ("no context", "copies")], "query_id string, question string")
    hits = spark.createDataFrame([(q, i + 1, t, f"c:{i}", "") for q in ("q", "none", "bare") for i, t in enumerate(BLOCKS)] + [("q", 9, None, "c:9", "")], "query_id string, rank int, text string, chunk_id string, doc_title string")
    rows = extractive.cited_sentences(questions, retrieval.contexts(hits, "query_id")).collect()
    assert {r.query_id for r in rows} == {"q"} and [r.n for r in rows] == [0, 1, 2] and all(BLOCKS[int(r.chunk_id[2:])][r.start : r.end] == r.sentence for r in rows)
    df = spark.createDataFrame([("A b, a c", "x B a"), ("?", "a"), ("a", None), (None, "a")], "s string, c string")
    assert [r[0] for r in df.select(extractive.cover(F.col("s"), F.col("c"))).collect()] == [pytest.approx(2 / 3), None, 0.0, None]
