"""Operator 12: best-two-fit packing of token pieces into sequences of fixed length.

Sequences are filled greedily (the longest piece left that fits, again and again); then a sequence's shortest piece makes room for the two
pieces left that fill the gap it leaves best, if they fill it better. Only lengths matter to that, so it is worked out on the
number of pieces of each length, a table of as many rows as a sequence has tokens however large the corpus: where a filled sequence can be
had m times over, it is taken m times at once. Pieces then take the places of their length in order. Texts are read once and tokenized
in one pass; narrow rows travel after that.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from docloom.llm.words import release
from docloom.session import fresh, small, store

CAPACITY, END = 1024, 2
#: Rows whose ids a task holds at once.
ROWS = 256
# Fixed value: how a byte-level tokenizer cuts a text.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[str, Callable[[str], list[int]]] = {}


def tokenizer(path: str) -> Callable[[str], list[int]]:
    """Ids of a text by a tokenizers file, loaded once a worker process.

    A byte-level BPE's ids are those that `tokenizers` gives; they are merged by `tiktoken` over the file's own vocabulary, in a fifth of the time.
    Any other file is run by `tokenizers` itself.
    """
    if path not in _loaded:
        from tokenizers import Tokenizer

        model = json.loads(Path(path).read_text(encoding="utf-8"))
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if model["model"]["type"] == "BPE" and model["normalizer"] is None and plain.items() <= (model["pre_tokenizer"] or {}).items() and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["special"] for t in model["added_tokens"]):
            _loaded[path] = _byte_level(model)
        else:
            _loaded[path] = lambda text, own=Tokenizer.from_file(path): own.encode(text, add_special_tokens=False).ids
    return _loaded[path]


def _byte_level(model: dict) -> Callable[[str], list[int]]:
    import tiktoken

    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    own = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)
    met = re.compile("|".join(map(re.escape, special))).search if special else lambda text: None
    return lambda text: own.encode(text, allowed_special="all") if met(text) else own.encode_ordinary(text)


def cut_pieces(n: int, capacity: int) -> list[int]:
    """Where the pieces of n tokens begin: all but the first have `capacity` tokens."""
    first = (n - 1) % capacity + 1
    return [0, *range(first, n, capacity)]


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32 and, with ids, the piece's ids; part and nth number the pieces of one length within a task."""
    kind = to_arrow_type(docs.schema[key].dataType)
    columns = {"key": kind, "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "part": pa.int64(), "nth": pa.int64()} | ({"ids": pa.list_(pa.int32())} if ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        encode = tokenizer(path)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                rows, numbers, starts, lengths, codes, own = [], [], [], [], [], []
                for r, words in enumerate(batch.column(0).slice(first, ROWS).to_pylist(), first):
                    whole = np.array([*encode(words or ""), end], "<u4")
                    at = cut_pieces(len(whole), capacity)
                    for k, (a, b) in enumerate(zip(at, [*at[1:], len(whole)])):
                        rows.append(r)
                        numbers.append(k)
                        starts.append(a)
                        lengths.append(b - a)
                        codes.append(zlib.crc32(whole[a:b]))
                        if ids:
                            own.append(whole[a:b].astype(np.int32))
                size = np.array(lengths, np.int64)
                order = np.argsort(size, kind="stable")
                run_start = np.searchsorted(size[order], size[order])
                nth = np.empty(len(size), np.int64)
                nth[order] = seen[size[order]] + np.arange(len(size)) - run_start
                seen += np.bincount(size, minlength=capacity + 1)
                made = [batch.column(1).take(pa.array(rows)), numbers, starts, size, codes, np.full(len(size), part), nth, *([own] if ids else [])]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(made, columns.values())], list(columns))
        release()

    said = f"key {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part long, nth long" + (", ids array<int>" if ids else "")
    return docs.select(F.col(text).cast("string").alias("_text"), F.col(key).alias("_key")).mapInArrow(run, said)


Plan = list[tuple[int, list[tuple[int, int]]]]


def fewest(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best-two-fit, or the greedy filling alone where all its sequences together are fewer: swaps use up short pieces early."""
    return min(best_two_fit(counts, capacity), best_two_fit(counts, capacity, swap=False), key=lambda plan: sum(times for times, _ in plan))


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY, swap: bool = True) -> Plan:
    """(how many sequences, their [(length, how many pieces)]) in the order of filling, for so many pieces of each length.

    A sequence's choices hold for as many as there are pieces for them, so the steps go by lengths that run out and not by pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []

    def longest(free: np.ndarray) -> np.ndarray:
        """For each size the longest piece left of at most that size, or 0."""
        return np.maximum.accumulate(np.where(free > 0, np.arange(capacity + 1), 0))

    while left.any():
        fits, gap, used, peak = longest(left), capacity, {}, {}
        size = int(fits[gap])
        while size:
            n = int(min(gap // size, left[size]))
            used[size] = peak[size] = n
            gap -= n * size
            size = int(fits[min(gap, size - 1)])
        if gap and swap:
            least = min(used)
            room = gap + least
            free = left.copy()
            for s, n in used.items():
                free[s] -= n
            # the piece taken out is not among those that take its place: alone it is no better, and with another it would not fit
            a = np.flatnonzero(free[: room + 1] > 0)
            fits, twice = longest(free), longest(np.where(free > 1, free, 0))
            b = np.minimum(fits[room - a], a)
            b = np.where((b == a) & (free[a] < 2), fits[np.maximum(a - 1, 0)], b)
            total = np.where(b > 0, a + b, 0)
            if len(a) and total.max() > least:
                i = len(total) - 1 - int(np.argmax(total[::-1]))  # of equal sums that with the longest piece
                used[least] -= 1
                for s in (int(a[i]), int(b[i])):
                    used[s] = used.get(s, 0) + 1
                    peak[s] = max(peak.get(s, 0), used[s])
                used = {s: n for s, n in used.items() if n}
        times = min(int((left[s] - peak[s]) // n) + 1 for s, n in used.items())
        for s, n in used.items():
            left[s] -= times * n
        out.append((times, sorted(used.items(), reverse=True)))
    return out


def places(plan: Plan) -> dict[str, np.ndarray]:
    """The plan as arrays by (length, first rank): which ranks of a length go to which sequences and offsets."""
    rows, taken, base = [], {}, 0
    for times, used in plan:
        offset = 0
        for length, n in used:
            first = taken.get(length, 0)
            rows.append((length, first, times, base, offset))
            taken[length] = first + times * n
            offset += n * length
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "times", "base", "offset"), table.T))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset and, with ids, ids: one row a piece of every row of docs; clashing key names are refused.

    A document's tokens are its ids and the end id. More than `capacity` are cut into pieces of that many, the first one shorter. Pieces lie
    in sequences gapless from offset 0, and no sequence holds more than `capacity` tokens. A null text counts as empty: the end id alone. Repeated
    rows have pieces of their own; pieces of equal length take places in the order of tasks and rows; a null key is kept. A text may be of any length, one
    task holds its ids. An empty table gives an empty table. Other columns of docs are ignored, whatever their names.
    """
    found = store(pieces_of(docs, path, capacity, end, ids, key, text), "pieces")
    by_part = store(found.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece_counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    held = docs.sparkSession.sparkContext.broadcast(places(fewest(counts, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    joined = found.join(small(starts), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    kept = ["key", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        order = (t["length"] << 48) + t["first"]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, len(kept)))
            i = np.searchsorted(order, (length << 48) + rank, "right") - 1
            nth = rank - t["first"][i]
            row, slot = nth % t["times"][i], nth // t["times"][i]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(t["base"][i] + row), pa.array(t["offset"][i] + slot * length)], [*kept, "sequence_id", "offset"])

    types = dict(joined.dtypes)
    said = ", ".join(f"{c} {types[c]}" for c in kept) + ", sequence_id long, offset long"
    out = joined.select(*kept, "rank").mapInArrow(place, said)
    if key in out.columns[1:]:
        raise ValueError(f"a key named {key} clashes with a column of the result")
    order = ["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if ids else [])]
    return out.select(*order).withColumnRenamed("key", key)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, documents: whole sequences of pack_documents(..., ids=True), pieces in the order of their offsets; a group is one sequence."""
    key = packed.columns[0]
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", F.col(key).alias("key"))))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.key").alias("documents"))
