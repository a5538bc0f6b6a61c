"""Operator 11: importance resampling toward a target distribution, over hashed word n-grams.

Two passes over the texts. Each reads Arrow's UTF-8 buffers in pieces: a lookup table tells word bytes from others, word boundaries are
where that changes, and the CRCs of all words advance side by side through a table of remainders, first through their own
bytes, then through the next word's, then through that after it. The first pass counts features by bucket (a row a bucket and task), the second adds up
each document's gains. Ranks come from a range sort of narrow rows, numbered range by range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.llm.sharding import number_rows
from docloom.llm.words import pieces, release
from docloom.session import fresh, store

BUCKETS, LONGEST, LEAST_WORDS = 10_000, 3, 20
#: Digits, letters and all bytes of characters beyond ASCII are word bytes; letters are made small.
_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
IS_WORD = ((LOWER >= 48) & (LOWER <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (_BYTES >= 128)
#: Fewer words than this still being read are finished one by one.
FEW = 16


def _remainders() -> np.ndarray:
    t = _BYTES.astype(np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


STEP = _remainders()


def advance(state: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC states after so many bytes from each start, one byte of all at a time; lengths fall, so those still being read stand first."""
    state = state.copy()
    if not len(state):
        return state
    ends = np.searchsorted(-length, -np.arange(int(length[0])), "left")  # how many are longer than 0, 1, 2 ...
    for j, n in enumerate(ends):
        if n < FEW:  # long words must not cost a step of all each
            for i in range(n):
                rest = data[start[i] + j : start[i] + length[i]].tobytes()
                state[i] = zlib.crc32(rest, int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
            break
        now = state[:n]
        state[:n] = STEP[(now ^ data[start[:n] + j]) & np.uint32(255)] ^ now >> np.uint32(8)
    return state


def word_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, bytes) of words in order, in a copy of the bytes that holds lower-cased words with one space behind each."""
    inside = IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    change = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts = np.flatnonzero((change[:-1] == 1) | (edge[:-1] & inside))
    ends = np.flatnonzero((change[1:] == -1) | (edge[1:] & inside)) + 1
    length = ends - starts
    own = np.cumsum(length) - length + np.arange(len(length))
    flat = np.full(int(length.sum()) + len(length), 32, np.uint8)
    flat[np.arange(len(flat) - len(length)) + np.repeat(np.arange(len(length)), length)] = LOWER[data[inside]]
    return np.searchsorted(offsets, starts, "right") - 1, own, length, flat


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of each run of 1 to `longest` words, repeats and all, and the words of each row."""
    rows, start, length, flat = word_bytes(data, offsets)
    order = np.argsort(-length, kind="stable")
    state = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    state[order] = advance(state, flat, start[order], length[order])
    found_rows, found = [rows], [state.copy()]
    for n in range(1, longest):
        # from each word whose n-th next is in its row, on through the space and that word; longest of those first
        first = order - n
        first = first[first >= 0]
        first = first[rows[first] == rows[first + n]]
        last = first + n
        state[first] = advance(state[first], flat, start[last] - 1, length[last] + 1)
        first = np.sort(first)
        found_rows.append(rows[first])
        found.append(state[first])
    codes = np.concatenate(found) ^ np.uint32(0xFFFFFFFF)
    return np.concatenate(found_rows), (codes % np.uint32(buckets)).astype(np.int64), np.bincount(rows, minlength=len(offsets) - 1)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket; buckets without any have no row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in pieces(batch.column(0)):
                total += np.bincount(features(data, offsets, buckets, longest)[1], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["bucket", "n"])
        release()

    return texts.select(F.col(text).cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """bucket, gain for every bucket: thousandths of the log ratio of its smoothed shares in the target and in docs, rounded down."""
    counted = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    for name, side in (("s", docs), ("t", target)):
        counted = counted.join(bucket_counts(side, text, buckets, longest).withColumnRenamed("n", name), "bucket", "left")
    counted = store(counted.fillna(0), "buckets")
    sums = counted.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).cast("double").alias("all_t"))
    ratio = (F.col("t").cast("double") + 1) * (F.col("all_s") + buckets) / ((F.col("s").cast("double") + 1) * (F.col("all_t") + buckets))
    return counted.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.ln(ratio)).cast("bigint").alias("gain"))  # one row of sums


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """key, the columns named in carry, n_features, weight, score, rank for every row of docs; clashing names get an underscore.

    A document of at least so many words is drawn if its score (weight plus Gumbel noise from sha256 of seed and key, in thousandths) is among
    the best floor(percent * N / 100) of the N such; its rank is 1, 2, 3 ... by falling score, ties to the smaller key (nulls first). Others have a null rank. To get
    the drawn documents themselves, carry their text and keep the rows with a rank. A null or empty text has no features and weight 0, and is
    never drawn; repeated rows have equal scores and ranks of their own; texts may be of any length; a null key is the word null.
    An empty docs table gives an empty table; with an empty target every bucket's share in it is the same.
    """
    weights = np.zeros(buckets, np.int64)
    for bucket, gain in gains(docs, target, text, buckets, longest).collect():  # one row a bucket, whatever the input
        weights[bucket] = gain
    held = docs.sparkSession.sparkContext.broadcast(weights)
    kept = [key, *(carry or [])]
    names = {n: fresh(n, kept) for n in ("n_features", "weight", "score", "rank", "words", "part", "nth", "minus", "fit")}
    kinds = [to_arrow_type(docs.schema[c].dataType) for c in kept]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            totals = np.zeros((3, n), np.int64)  # features, weight, words
            for first, data, offsets in pieces(batch.column(0)):
                size = len(offsets) - 1
                rows, found, words = features(data, offsets, buckets, longest)
                here = slice(first, first + size)
                totals[0, here] = np.bincount(rows, minlength=size)
                totals[1, here] = np.bincount(rows, weights=held.value[found], minlength=size)  # whole numbers under 2**53
                totals[2, here] = words
            made = [*totals, np.full(n, part), np.arange(seen, seen + n)]
            seen += n
            yield pa.RecordBatch.from_arrays([*[c.cast(t) for c, t in zip(batch.columns[1:], kinds)], *[pa.array(c, pa.int64()) for c in made]], [*kept, *[names[c] for c in ("n_features", "weight", "words", "part", "nth")]])
        release()

    said = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept], *[f"`{names[c]}` long" for c in ("n_features", "weight", "words", "part", "nth")]])
    rows = docs.select(F.col(text).cast("string").alias("_text"), *[F.col(c) for c in kept]).mapInArrow(weigh, said)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    rows = rows.withColumn(names["score"], (F.col(names["weight"]) + noise).cast("bigint"))
    rows = store(rows.withColumns({names["minus"]: -F.col(names["score"]), names["fit"]: F.col(names["words"]) >= least_words}), "scored")
    drawn = rows.where(names["fit"]).count() * percent // 100
    # part and nth make every row's place in the order its own, so equal rows spread over ranges too
    place = fresh("place", rows.columns)
    numbered = number_rows(rows, names["fit"], [names["minus"], key, names["part"], names["nth"]], place)
    rank = F.when(F.col(names["fit"]) & (F.col(place) < drawn), F.col(place) + 1).cast("bigint")
    return numbered.select(*kept, names["n_features"], names["weight"], names["score"], rank.alias(names["rank"]))
