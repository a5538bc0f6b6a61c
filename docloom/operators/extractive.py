"""Answers made of the context's own sentences: chosen by maximal marginal relevance, each cited by its place in its block."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import SENTENCE_GAP, lexical_tokens

#: Sentences of an answer, and how much relevance counts against being unlike what is said already.
SENTENCES, BALANCE = 3, 0.7
CITED = "query_id string, n int, chunk_id string, start int, end int, sentence string, relevance double"


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Begin and end of each sentence, without white space at either side."""
    cuts = [0, *(x for m in re.finditer(SENTENCE_GAP, text) for x in m.span()), len(text)]
    out = []
    for a, b in zip(cuts[::2], cuts[1::2]):
        said = text[a:b]
        if said.strip():
            out.append((a + len(said) - len(said.lstrip()), b - len(said) + len(said.rstrip())))
    return out


def _terms(text: str) -> Counter:
    return Counter(re.findall("[a-z0-9]+", text.lower()))


def choose(question: str, texts: list[str], most: int = SENTENCES, balance: float = BALANCE) -> list[tuple[int, int, int, float]]:
    """(block, begin, end, relevance) of the chosen sentences, in the order of choice.

    Sentences are vectors of term counts by idf over these blocks' sentences, relevance is the cosine to the question. The next one is that of the greatest
    balance * relevance - (1 - balance) * its greatest cosine to one chosen; of equals the first in the blocks. One without a term of the question is not chosen.
    """
    spans = [(i, a, b) for i, t in enumerate(texts) for a, b in sentence_spans(t)]
    counts = [_terms(texts[i][a:b]) for i, a, b in spans]
    df = Counter(w for c in counts for w in c)
    asked = _terms(question)

    def unit(c: Counter) -> dict[str, float]:
        v = {w: n * math.log(1 + len(spans) / (1 + df[w])) for w, n in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()} if size else {}

    def cosine(a: dict[str, float], b: dict[str, float]) -> float:
        return sum(x * b[w] for w, x in a.items() if w in b)

    vectors, wanted = [unit(c) for c in counts], unit(asked)
    relevance = [cosine(wanted, v) for v in vectors]
    near, chosen = [0.0] * len(spans), []
    while len(chosen) < most:
        scores = [(balance * r - (1 - balance) * n, -i) for i, (r, n) in enumerate(zip(relevance, near)) if r > 0 and i not in chosen]
        if not scores:
            break
        chosen.append(-max(scores)[1])
        near = [max(n, cosine(v, vectors[chosen[-1]])) for n, v in zip(near, vectors)]
    return [(*spans[i], relevance[i]) for i in chosen]


def extract(question: str, blocks: list[dict]) -> dict:
    """A model for answer(): its reply is the chosen sentences, each with a citation that tells where in the block's text it stands."""
    said = []
    for i, a, b, _ in choose(question, [x["text"] for x in blocks]):
        quote = blocks[i]["text"][a:b]
        said.append({"type": "text", "text": ("" if not said else " ") + quote, "citations": [{"cited_text": quote, "document_index": i, "start": a, "end": b}]})
    return {"content": said or [{"type": "text", "text": "The context does not say."}], "usage": None}


def cited_sentences(questions: DataFrame, blocks: DataFrame, most: int = SENTENCES, balance: float = BALANCE) -> DataFrame:
    """query_id, n, chunk_id, start, end, sentence, relevance: the answer's sentences to each question (query_id, question) from its context (contexts()'s rows of
    query_id and blocks, a handful each). A question without context, and one that no sentence meets, has no row."""

    def run(batches):
        for batch in batches:
            rows = []
            for query, question, held in zip(batch["query_id"], batch["question"], batch["blocks"]):
                found = list(held)
                for n, (i, a, b, relevance) in enumerate(choose(question or "", [x["text"] or "" for x in found], most, balance)):
                    rows.append((query, n, found[i]["chunk_id"], a, b, found[i]["text"][a:b], relevance))
            yield pd.DataFrame(rows, columns=["query_id", "n", "chunk_id", "start", "end", "sentence", "relevance"])

    some = F.transform("blocks", lambda b: F.struct(b["chunk_id"].alias("chunk_id"), b["text"].alias("text")))
    return questions.select("query_id", "question").join(blocks.select("query_id", some.alias("blocks")), "query_id").mapInPandas(run, CITED)


def cover(said: Column, context: Column) -> Column:
    """The share of what is said, by distinct lexical terms, that the context has too; null where nothing is said."""
    terms = F.array_distinct(lexical_tokens(said))
    return F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, lexical_tokens(F.coalesce(context, F.lit(""))))) / F.size(terms))
