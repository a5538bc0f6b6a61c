"""Sentences merged to chunks by an ordered fold within each document; documents fold in parallel."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.functions.text import sentences
from docloom.operators.segment import segments
from docloom.session import spread

THRESHOLD, LEAST, MOST = 0.55, 128, 512
#: Chunks that a task sends on at once.
SENT = 256
CHUNK = "ordinal int, chunk_id string, text string, breadcrumb array<string>, token_count bigint, sentences int"


def words(text: str) -> int:
    return len(text.split())


class _Codes(dict):
    """crc32 of words, kept while there are not too many of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = code = zlib.crc32(word)
        return code


_codes = _Codes()
#: Bytes that are no part of a lexical term, as spaces; those of letters beyond ASCII are none in UTF-8.
_TERM_BYTES = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))


def term_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(which text, crc32) of each lexical term of some texts, in order."""
    found = [t.lower().encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split() for t in texts]
    sizes = [len(f) for f in found]
    return np.repeat(np.arange(len(texts)), sizes), np.fromiter(map(_codes.__getitem__, chain.from_iterable(found)), np.int64, sum(sizes))


def hashed_vectors(texts: list[str], size: int = 384) -> np.ndarray:
    """Offline embedder: word counts in `size` hashed places, of unit length."""
    row, code = term_codes(texts)
    out = np.bincount(row * size + code % size, minlength=len(texts) * size).reshape(len(texts), size)
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]  # of whole numbers, so exact in any order
    return out / np.where(norm == 0, 1, norm)


def in_blocks(embed: Callable, texts: list[str], size: int = 512) -> Iterator[np.ndarray]:
    """Vectors of texts one by one, made so many at a time: a document of any length has few of them in memory."""
    for at in range(0, len(texts), size):
        yield from embed(texts[at : at + size])


def fold(tokens: list[int], crumbs: list[tuple], vectors: Iterable[np.ndarray] | None, least: int, most: int, threshold: float) -> list[tuple[int, int]]:
    """Ranges of sentences of each chunk. A sentence that would pass `most` starts a new chunk, as does one of another
    section or of low mean similarity to the chunk once that has `least` tokens."""
    out, start = [], 0
    if not tokens:
        return out
    following = None if vectors is None else iter(vectors)
    total, mean = tokens[0], None if following is None else np.array(next(following), float)
    for i in range(1, len(tokens)):
        vector = None if following is None else np.asarray(next(following), float)
        # what a chunk of fewer than `least` tokens is like does not matter
        if total + tokens[i] > most or total >= least and (crumbs[i] != crumbs[start] or (mean is not None and float(mean @ vector) < threshold)):
            out.append((start, i))
            start, total = i, tokens[i]
            mean = None if vector is None else vector.copy()
        else:
            total += tokens[i]
            if mean is not None:
                step = vector - mean
                step /= i - start + 1
                mean += step
    return [*out, (start, len(tokens))]


def chunk_documents(docs: DataFrame, least: int = LEAST, most: int = MOST, threshold: float = THRESHOLD, embed: Callable | None = hashed_vectors, count: Callable[[str], int] = words, carry: list[str] | None = None) -> DataFrame:
    """Chunks of docs (doc_id, text, mime_type). embed None: only sections and token bounds cut. Columns named in carry
    go with each chunk."""
    kept = ["doc_id", *(carry or [])]
    parts = spread(docs.select(*kept, "text", "mime_type")).select(*kept, segments(F.col("text"), F.col("mime_type")).alias("segments"))
    split = F.transform("segments", lambda s: F.struct(s["breadcrumb"].alias("breadcrumb"), sentences(s["text"]).alias("sentences")))

    kinds = [to_arrow_type(docs.schema[c].dataType) for c in kept]
    names = [*kept, "ordinal", "chunk_id", "text", "breadcrumb", "token_count", "sentences"]
    types = [*kinds, pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int32()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a document at a time, so that a worker holds one and the chunks it has not sent yet
        rows: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                *own, parts = (c[i].as_py() for c in batch.columns)
                flat = [(t, tuple(p["breadcrumb"])) for p in parts or () for t in p["sentences"]]
                texts, crumbs = [f[0] for f in flat], [f[1] for f in flat]
                ranges = fold([count(t) for t in texts], crumbs, in_blocks(embed, texts) if embed else None, least, most, threshold)
                for k, (a, b) in enumerate(ranges):
                    path = " -> ".join(c for c in crumbs[a] if c)
                    text = (f"[{path}] " if path else "") + " ".join(texts[a:b])
                    rows.append((*own, k, f"{own[0]}:{k}", text, list(crumbs[a]), count(text), b - a))
                if len(rows) >= SENT:
                    yield table(rows)
                    rows = []
        yield table(rows)

    said = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return parts.select(*kept, split.alias("parts")).mapInArrow(run, f"{said}, {CHUNK}")
