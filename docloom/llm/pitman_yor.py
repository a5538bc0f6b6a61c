"""Operator 2: language-model scoring by a hierarchical Pitman-Yor process.

Each context (the word before, by 48 bits of its hash) has a Chinese restaurant whose dishes are the words that follow; new
tables draw their dish from one shared parent restaurant of all words, whose own new tables draw from a uniform base
over the vocabulary and one unknown word. The tables of the contexts are the parent's customers.

Gibbs sampling is by dish: all customers of a word in a context get up and sit down again, which changes nothing but the
number of their tables; that number is drawn from its exact distribution given all other tables, by generalised
Stirling numbers (for many customers by their series or saddle-point form, in Metropolis steps). The dishes of a bucket move in two halves, each
seeing what the other did. Words are spread over buckets by hash, so all of a word's contexts, its parent tables and its
occurrences lie in one row; a bucket takes several sweeps and then the restaurants' sizes go round: each bucket sends its part
of the tables of the contexts that it meets to the contexts' ranges of hashes, where they are added up and sent back to the
buckets that asked; no task and no vector holds all contexts. Between rounds the seating is kept in a table. The last rounds'
predictive probabilities are averaged, and their logarithms sum to a text's score. Seating is drawn from a seed, bucket
and sweep, so a lost task repeats itself. After each round both levels' discounts are drawn from their distribution over a
grid, given all seatings (griddy Gibbs): buckets and ranges send their part of its logarithm.

A bucket with more than its share of a chunk's occurrences (a very frequent word) is split: its chunks go to several
rows by salt. Their restaurants are summed in two steps and sent back to every row of the bucket, and each row scores its own occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.words import buckets, deltas, mix, pack, pieces, unpack, word_hashes
from docloom.session import new_path, small, store

#: Rounds of sweeps between exchanges of the restaurants' sizes, those whose predictions are averaged, and sweeps a round.
ROUNDS, KEPT, SWEEPS = 3, 2, 3
#: Customers of a dish up to which its tables are drawn by exact Stirling numbers, and Metropolis steps a sweep beyond.
EXACT, STEPS = 64, 6
#: Discounts that are drawn from.
GRID = tuple(round(0.30 + 0.02 * k, 2) for k in range(33))
#: Documents of a row of sums.
GROUP = 4096
CHUNK, BUCKET_BYTES, SEED = 1_000_000, 8 << 20, 7
#: Restaurants are added up in ranges of their hashes, one range for so many buckets.
PART = 8
END, START = (mix(np.array([x], np.uint64))[0] for x in (1, 2))
STRENGTH = 1.0


class Sizes(NamedTuple):
    """What a sweep needs of the state before it besides the tables of its contexts: customers and tables of the parent."""

    customers: int
    parent_tables: int


class Prior(NamedTuple):
    """Training tokens and vocabulary, which are fixed, and the present discounts."""

    tokens: int
    words: int
    discount: float
    parent_discount: float


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 7, is 2; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _pack_ids(ids: list[int | None]) -> bytes:
    return bytes(x is None for x in ids) + np.array([x or 0 for x in ids], np.int64).tobytes()


def _unpack_ids(data: bytes) -> list[int | None]:
    n = len(data) // 9
    return [None if null else x for null, x in zip(data[:n], np.frombuffer(data[n:], np.int64).tolist())]


def _chunks(batches, n: int, size: int) -> Iterator[pa.RecordBatch]:
    """Entries (word, context, document, count) of runs of rows, packed by bucket of the word; a bucket of k times the
    entries that it would hold if all were alike is spread over k / 2 salts, a chunk going whole to one of them."""
    held, keys, flags, ids, total = [], [], [], [], 0
    ends = int(buckets(np.array([END]), n, 64)[0])

    def flush():
        nonlocal held, keys, flags, ids, total
        words, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        names, context = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)
        # word and context, then these and the document, in one integer: chunks hold under 2**32 of each
        pairs, pair = np.unique((at.astype(np.uint64) << np.uint64(32)) | context.astype(np.uint64), return_inverse=True)
        joint, counts = np.unique((pair.astype(np.uint64) << np.uint64(32)) | np.concatenate([h[2] for h in held]), return_counts=True)
        pair = pairs[(joint >> np.uint64(32)).astype(np.int64)]
        at, context = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.searchsorted(buckets(words, n, 64), np.arange(n + 1))
        rows = {k: [] for k in ("bucket", "salt", "words", "runs", "contexts", "names", "documents", "counts")}
        for b in range(n):
            i, j = cut[b], cut[b + 1]
            if j == i:
                continue
            x, y = np.searchsorted(at, [i, j])
            salts = max(1, int(y - x) * n // (2 * max(len(joint), size // 2)))
            rows["bucket"].append(b)
            rows["salt"].append(int(mix(np.array([keys[0]], np.uint64))[0] % np.uint64(salts)))
            rows["words"].append(pack(deltas(words[i:j])))
            rows["runs"].append(pack(np.bincount(at[x:y] - i, minlength=j - i)))
            met, own = np.unique(context[x:y], return_inverse=True)
            rows["contexts"].append(pack(own))
            rows["names"].append(pack(deltas(names[met])))
            rows["documents"].append(pack(joint[x:y] & np.uint64(0xFFFFFFFF)))
            rows["counts"].append(pack(counts[x:y]))
        m = len(rows["bucket"])
        own, train = pack(deltas(np.array(keys, np.uint64))), pack(np.array(flags))
        # every text has an end token, so that token's bucket alone carries the documents' ids
        named = _pack_ids(ids)
        out = pa.RecordBatch.from_arrays(
            [
                *[pa.array(rows[k], pa.int32()) for k in ("bucket", "salt")], *[pa.array(rows[k], pa.binary()) for k in list(rows)[2:]],
                pa.array([own] * m, pa.binary()), pa.array([train] * m, pa.binary()), pa.array([named if b == ends else None for b in rows["bucket"]], pa.binary()),
            ],
            [*rows, "keys", "train", "ids"],
        )
        held, keys, flags, ids, total = [], [], [], [], 0
        return out

    for batch in batches:
        own, train, named = (batch.column(i).to_pylist() for i in range(3))
        for first, data, offsets in pieces(batch.column(3)):
            docs = len(offsets) - 1
            rows, hashes = word_hashes(data, offsets)
            before = np.full(len(hashes), START, np.uint64)
            before[1:] = np.where(rows[1:] == rows[:-1], hashes[:-1], START)
            bounds = np.searchsorted(rows, np.arange(docs + 1))
            last = np.full(docs, START, np.uint64)
            some = bounds[1:] > bounds[:-1]
            last[some] = hashes[bounds[1:][some] - 1]
            word = np.concatenate([hashes, np.full(docs, END, np.uint64)])
            context = np.concatenate([before, last]) >> np.uint64(16)
            held.append((word, context, np.concatenate([rows, np.arange(docs)]).astype(np.uint64) + np.uint64(len(keys))))
            keys += own[first : first + docs]
            flags += train[first : first + docs]
            ids += named[first : first + docs]
            total += len(word)
            if total >= size:
                yield flush()
    if total:
        yield flush()


def _restaurants(word: np.ndarray, contexts: np.ndarray, names: np.ndarray, trained: np.ndarray) -> dict[str, bytes]:
    """Packed restaurants of sorted (word, place of the context in names) pairs and their training counts, with the sums that the prior needs."""
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    seen = np.add.reduceat(trained, starts)
    by_word = np.add.reduceat((trained > 0).astype(np.int64), starts)
    sums = [trained.sum(), (seen > 0).sum(), (trained == 1).sum(), (trained == 2).sum(), (by_word == 1).sum(), (by_word == 2).sum(), by_word.sum()]
    found = {
        "words": deltas(word[starts]), "pairs": np.diff(np.r_[starts, len(word)]), "contexts": contexts, "names": deltas(names), "trained": trained,
        "customers": np.bincount(contexts, trained, len(names)).astype(np.int64), "tables": np.bincount(contexts[trained > 0], minlength=len(names)), "sums": np.array(sums),
    }
    return {k: pack(v) for k, v in found.items()}


def _named(row: dict) -> np.ndarray:
    """The contexts of a row's pairs or entries."""
    return np.cumsum(unpack(row["names"]), dtype=np.uint64)[unpack(row["contexts"]).astype(np.int64)]


def _merge(part: pa.Table) -> pa.Table:
    """One row of a bucket and salt: its words, their (word, context) pairs with training counts, and occurrences by document."""
    words, contexts, keys, counts, train, named = [], [], [], [], [], {}
    part_rows = part.to_pylist()
    for row in part_rows:
        runs = unpack(row["runs"]).astype(np.int64)
        own = np.cumsum(unpack(row["keys"]), dtype=np.uint64).astype(np.int64)
        if row["ids"] is not None:
            named.update(zip(own.tolist(), _unpack_ids(row["ids"])))
        docs = unpack(row["documents"]).astype(np.int64)
        words.append(np.repeat(np.cumsum(unpack(row["words"]), dtype=np.uint64), runs))
        contexts.append(_named(row))
        keys.append(own[docs])
        counts.append(unpack(row["counts"]).astype(np.int32))
        train.append(unpack(row["train"]).astype(bool)[docs])
    word, context, key, count, flag = (np.concatenate(x) for x in (words, contexts, keys, counts, train))
    del words, contexts, keys, counts, train, part_rows
    names, context = np.unique(context, return_inverse=True)
    order = np.lexsort((context, word))
    word, context = word[order], context[order]
    new_word = np.r_[True, word[1:] != word[:-1]]
    pair = np.flatnonzero(new_word | np.r_[True, context[1:] != context[:-1]])
    key, count, flag = key[order], count[order], flag[order]
    docs, document = np.unique(key, return_inverse=True)
    trained = np.add.reduceat(np.where(flag, count, 0), pair)
    binary = lambda x: pa.array([x], pa.binary())
    return pa.table(
        {
            "bucket": part.column("bucket").slice(0, 1).combine_chunks(),
            "salt": part.column("salt").slice(0, 1).combine_chunks(),
            **{k: binary(v) for k, v in _restaurants(word[pair], context[pair], names, trained).items()},
            "runs": binary(pack(np.diff(np.r_[pair, len(word)]))),
            "documents": binary(pack(document)),
            "counts": binary(pack(count)),
            "keys": binary(pack(deltas(docs.astype(np.uint64)))),
            "ids": binary(_pack_ids([named[k] for k in docs.tolist()]) if named else None),
        }
    )


def _add_restaurants(part: pa.Table) -> pa.Table:
    """The restaurants of several rows of one bucket as one row; salt becomes their largest."""
    found = part.select(["words", "pairs", "contexts", "names", "trained"]).to_pylist()
    word = np.concatenate([np.repeat(np.cumsum(unpack(r["words"]), dtype=np.uint64), unpack(r["pairs"]).astype(np.int64)) for r in found])
    trained = np.concatenate([unpack(r["trained"]).astype(np.int64) for r in found])
    names, context = np.unique(np.concatenate([_named(r) for r in found]), return_inverse=True)
    order = np.lexsort((context, word))
    word, context = word[order], context[order]
    pair = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (context[1:] != context[:-1])])
    out = _restaurants(word[pair], context[pair], names, np.add.reduceat(trained[order], pair))
    ends = {"bucket": part.column("bucket")[0].as_py(), "salt": max(part.column("salt").to_pylist())}
    return pa.table({**{k: pa.array([v], pa.int32()) for k, v in ends.items()}, **{k: pa.array([v], pa.binary()) for k, v in out.items()}})


_STATE = "words binary, pairs binary, contexts binary, names binary, trained binary, customers binary, tables binary, sums binary"
_BUCKET = f"bucket int, salt int, {_STATE}, runs binary, documents binary, counts binary, keys binary, ids binary"
#: Rows of a split bucket that one task adds up at a time.
FAN_IN = 64


def _restaurant_rows(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows by bucket and salt: one row of restaurants a bucket, and the rows to score, with their bucket's restaurants."""
    state, seats = ["pairs", "contexts", "trained", "names", "customers", "tables", "sums"], ["runs", "documents", "counts", "keys", "ids"]
    none = [F.lit(None).cast("binary").alias(k) for k in ("words", "own_words", "own_pairs", "own_contexts", "own_names")]
    scored = lambda df: df.select("bucket", *state[:4], *seats, *none)
    split = table.where("salt > 0").select("bucket").distinct()
    if split.isEmpty():
        return table.select("bucket", *state), scored(table)
    split = small(split)
    whole, parts = table.join(split, "bucket", "left_anti"), table.join(split, "bucket", "left_semi")
    schema = f"bucket int, salt int, {_STATE}"
    added = parts.select("bucket", "salt", "words", *state[:4]).groupBy("bucket", F.floor(F.col("salt") / FAN_IN)).applyInArrow(_add_restaurants, schema)
    added = store(added.groupBy("bucket").applyInArrow(_add_restaurants, schema), "split-restaurants")
    sent = added.select("bucket", F.explode(F.sequence(F.lit(0), F.col("salt"))).alias("salt"), "words", *state[:4])
    own = parts.select("bucket", "salt", *[F.col(k).alias(f"own_{k}") for k in ("words", "pairs", "contexts", "names")], *seats)
    joined = own.join(sent, ["bucket", "salt"]).select("bucket", *state[:4], *seats, "words", "own_words", "own_pairs", "own_contexts", "own_names")
    return whole.select("bucket", *state).unionByName(added.select("bucket", *state)), scored(whole).unionByName(joined)


def _total(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Sums of (slice, packed values) by slice: a fixed number of rows of fixed length for the driver."""

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": part["slice"][:1], "values": [pack(sum(unpack(v) for v in part["values"]))]})

    rows = vectors.groupBy("slice").applyInPandas(add, "slice int, values binary").collect()
    return {r["slice"]: unpack(bytes(r["values"])).astype(np.int64) for r in rows}


def _sent(number: int, names: np.ndarray, values: dict[str, np.ndarray], parts: int, sums: tuple[int, int] = (0, 0)) -> Iterator[dict]:
    """A bucket's sizes of its contexts, a row for each range of hashes that it meets; sums stand in the first."""
    cut = np.searchsorted(buckets(names, parts, 48), np.arange(parts + 1))
    for p in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        i, j = cut[p], cut[p + 1]
        yield {"bucket": number, "part": p, "names": pack(deltas(names[i:j])), "customers": sums[0], "parent_tables_": sums[1]} | {k: pack(v[i:j]) for k, v in values.items()}
        sums = (0, 0)


def _sent_schema(values: list[str]) -> str:
    return ", ".join(["bucket int, part int, names binary, customers bigint, parent_tables_ bigint", *[f"{k} binary" for k in values]])


_KINDS = {"bucket": pa.int32(), "part": pa.int32(), "names": pa.binary(), "customers": pa.int64(), "parent_tables_": pa.int64()}


def _batch(rows: list[dict], values: list[str]) -> pa.RecordBatch:
    kinds = _KINDS | {k: pa.list_(pa.float64()) if k == "fit" else pa.binary() for k in values}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))


def _fit_total(rows: DataFrame) -> np.ndarray:
    """Sum of the arrays in fit, one number a place."""
    found = rows.where("fit IS NOT NULL").select(F.posexplode("fit").alias("place", "x")).groupBy("place").agg(F.sum("x")).collect()
    out = np.zeros(max((r[0] for r in found), default=-1) + 1)
    for place, x in found:
        out[place] = x
    return out


def _added(sent: DataFrame, values: list[str]) -> tuple[DataFrame, Sizes, np.ndarray]:
    """Of rows by bucket and range: the values' sums over all buckets, as arrays by range in a row for each bucket; the sums'
    sums; and what the contexts' tables say of the discount."""

    def add(part: pa.Table) -> pa.Table:
        found = part.to_pylist()
        names = [np.cumsum(unpack(r["names"]), dtype=np.uint64) for r in found]
        _, at = np.unique(np.concatenate(names), return_inverse=True)
        ends = np.cumsum([len(x) for x in names])[:-1]
        out = {k: part.column(k) for k in ("bucket", "part", "customers", "parent_tables_")}
        fit = None
        for k in values:
            sums = np.bincount(at, np.concatenate([unpack(r[k]) for r in found]).astype(np.float64)).astype(np.int64)
            out[k] = pa.array([pack(x) for x in np.split(sums[at], ends)], pa.binary())
            fit = restaurant_fit(sums)  # of the last value, the tables
        return pa.table(out | {"fit": pa.array([fit.tolist(), *[None] * (len(found) - 1)], pa.list_(pa.float64()))})

    schema = _sent_schema(values).replace(" names binary,", "") + ", fit array<double>"
    path = new_path(sent.sparkSession, "sizes")
    sent.groupBy("part").applyInArrow(add, schema).write.parquet(path)
    summed = sent.sparkSession.read.schema(schema).parquet(path)
    sums = summed.agg(F.sum("customers"), F.sum("parent_tables_")).first()
    rows = summed.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("part", *values))).alias("found"))
    return rows.select("bucket", *[F.col("found")[k].alias(k) for k in values]), Sizes(sums[0] or 0, sums[1] or 0), _fit_total(summed)


def _vector(found: list[bytes]) -> np.ndarray:
    return np.concatenate([unpack(x).astype(np.int64) for x in found])


def prior_of(rows: DataFrame, parts: int) -> tuple[Prior, Sizes, DataFrame]:
    """The prior, the sizes before the first sweep, and of each bucket its contexts' customers (seated) and tables (tables0)."""

    def vectors(batches):
        for batch in batches:
            for number, names, seated, tables in zip(*(c.to_pylist() for c in batch.columns)):
                names = np.cumsum(unpack(names), dtype=np.uint64)
                yield _batch(list(_sent(number, names, {"seated": unpack(seated), "tables0": unpack(tables)}, parts)), ["seated", "tables0"])

    found = _total(rows.select(F.lit(0).alias("slice"), F.col("sums").alias("values")))
    tokens, words, ones, twos, single, double, tables = (int(x) for x in found.get(0, np.zeros(7, np.int64)))
    discount = lambda a, b: float(np.clip(a / (a + 2 * b) if a + b else 0.5, 0.05, 0.95))
    prior = Prior(tokens, words, discount(ones, twos), discount(single, double))
    sent = rows.select("bucket", "names", "customers", "tables").mapInArrow(vectors, _sent_schema(["seated", "tables0"]))
    return prior, Sizes(tables, words), store(_added(sent, ["seated", "tables0"])[0], "seated")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, from 6 places up."""
    shift = np.zeros_like(x)
    for k in range(6):
        shift -= np.log(x + k)
    y = x + 6
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3)


@lru_cache(64)
def stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: [c, t] weighs all ways for c customers to sit at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 1)
        out[c + 1, 1 : c + 1] = out[c, 1 : c + 1] + np.log(c - discount * t)
        out[c + 1, 2 : c + 2] = np.logaddexp(out[c + 1, 2 : c + 2], out[c, 1 : c + 1])
    return out


def stirling_many(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The same for many customers. For up to c**d tables, and half of c, by the alternating sum of t over k times the rising factorials
    of -k d, whose terms fall off quickly there; beyond, where it cancels out, as the coefficient of x**c in
    c!/t! ((1 - (1 - x)**d) / d)**t at its saddle point."""
    out, few = np.empty_like(t), t <= np.minimum(c**d, c / 2)
    if few.any():
        n, m = c[few, None], t[few, None]
        k = np.arange(1.0, 25.0)[None, :]
        gap = np.maximum(m - k, 0.0)
        size = _log_gamma(m + 1) - _log_gamma(k + 1) - _log_gamma(gap + 1) + _log_gamma(n - k * d) + _log_gamma(1 + k * d)
        size = np.where(k <= m, size, -np.inf)
        top = size.max(1, keepdims=True)
        terms = -((-1.0) ** k) * np.sin(np.pi * k * d) * np.exp(size - top)
        total = np.maximum(terms.sum(1), 1e-300)
        out[few] = top[:, 0] + np.log(total) - np.log(np.pi) - t[few] * np.log(d) - _log_gamma(t[few] + 1)
    if not few.all():
        out[~few] = _saddle(c[~few], t[~few], d)
    return out


def _saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    low, high = np.zeros_like(c), np.ones_like(c)
    for _ in range(50):
        x = (low + high) / 2
        slope = t * x * (1 - x) ** (d - 1) * d / (1 - (1 - x) ** d)
        low, high = np.where(slope < c, x, low), np.where(slope < c, high, x)
    x = (low + high) / 2
    f = (1 - (1 - x) ** d) / d
    r = x * (1 - x) ** (d - 1) / f
    spread = t * (r + (1 - d) * x * x * (1 - x) ** (d - 2) / f - r * r)
    return _log_gamma(c + 1) - _log_gamma(t + 1) + t * np.log(f) - c * np.log(x) - 0.5 * np.log(2 * np.pi * np.maximum(spread, 1e-9))


def seating_fit(customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """For each discount of the grid, the logarithm of the ways for these customers to sit at so many tables."""
    at = (customers > 1) & (customers <= EXACT)
    pairs, n = np.unique(customers[at] * (EXACT + 1) + tables[at], return_counts=True)
    many = customers > EXACT
    c, t = customers[many].astype(np.float64), tables[many].astype(np.float64)
    out = []
    for d in GRID:
        out.append(float((stirling(d).reshape(-1)[pairs] * n).sum() + (stirling_many(c, t, d).sum() if len(c) else 0.0)))
    return np.array(out)


def restaurant_fit(tables: np.ndarray) -> np.ndarray:
    """For each discount, the logarithm of what opening so many tables weighs in restaurants."""
    t, n = np.unique(tables[tables > 0], return_counts=True)
    t = t.astype(np.float64)
    return np.array([float((n * (t * np.log(d) + _log_gamma(STRENGTH / d + t) - _log_gamma(np.full(len(t), STRENGTH / d)))).sum()) for d in GRID])


def draw_discount(fit: np.ndarray, rng: np.random.Generator) -> float:
    chance = np.exp(np.round(fit - fit.max(), 6))
    return GRID[int(rng.choice(len(GRID), p=chance / chance.sum()))]


class Parent(NamedTuple):
    """What new tables of some dishes meet in the restaurant above: the dish's own customers and tables there without those that
    are drawn anew, all customers, and what a new table there weighs. Without customers: a fixed probability, new."""

    own: np.ndarray
    tables: np.ndarray
    customers: np.ndarray
    new: np.ndarray
    discount: float
    fixed: bool = False

    def take(self, at: np.ndarray) -> Parent:
        return self._replace(own=self.own[at], tables=self.tables[at], customers=self.customers[at], new=self.new[at])

    def log_chance(self, j: int) -> np.ndarray:
        """Of the dish being drawn once more after j times."""
        if self.fixed:
            return np.log(self.new)
        seats = self.own + j - self.discount * np.maximum(self.tables, j > 0)
        return np.log((np.maximum(seats, 0.0) + self.new) / (STRENGTH + self.customers + j))

    def log_chances(self, n: np.ndarray) -> np.ndarray:
        """Of the dish being drawn n times, n many."""
        if self.fixed:
            return n * np.log(self.new)
        first = np.maximum(self.own - self.discount * np.maximum(self.tables, 1) + self.new, 1e-3)
        return _log_gamma(first + n) - _log_gamma(first) - _log_gamma(STRENGTH + self.customers + n) + _log_gamma(STRENGTH + self.customers)


def seat(customers: np.ndarray, tables: np.ndarray, others: np.ndarray, parent: Parent, discount: float, rng: np.random.Generator) -> np.ndarray:
    """New numbers of tables of dishes of two customers or more. others: tables of the other dishes of each one's restaurant.

    The chance of t tables is the Stirling number of customers and t, times (strength + discount x (others + j)) for each new table
    but that after others + j ones, times the chances of the dish above.
    """
    out = tables.copy()
    bounds = [1, 4, 16, EXACT]
    exact = stirling(discount)
    for low, high in zip(bounds, bounds[1:]):
        at = np.flatnonzero((customers > low) & (customers <= high))
        if not len(at):
            continue
        above, weight = parent.take(at), np.full((len(at), high), -np.inf)
        total = np.zeros(len(at))
        for j in range(high):
            total = total + np.log(STRENGTH + discount * (others[at] + j)) + above.log_chance(j)
            weight[:, j] = exact[customers[at], j + 1] + total
        weight -= weight.max(1, keepdims=True)
        sums = np.cumsum(np.exp(weight), 1)
        out[at] = (sums < (rng.random(len(at)) * sums[:, -1])[:, None]).sum(1) + 1
    at = np.flatnonzero(customers > EXACT)
    if len(at):
        above, c, t, first = parent.take(at), customers[at].astype(np.float64), tables[at].astype(np.float64), STRENGTH / discount + others[at]

        def weigh(n):
            return stirling_many(c, n, discount) + n * np.log(discount) + _log_gamma(first + n) - _log_gamma(first) + above.log_chances(n)

        now = weigh(t)
        for step in range(STEPS):
            # the width goes by what does not move, so a step back is as likely
            wide = np.maximum(1.0, c ** (discount / 2) * (0.5 if step % 2 else 2.0))
            new = np.rint(t + rng.normal(size=len(t)) * wide)
            fits = (new >= 1) & (new < c)
            new = np.where(fits, new, t)
            chance = weigh(new)
            moved = fits & (np.log(rng.random(len(t))) < chance - now)
            t, now = np.where(moved, new, t), np.where(moved, chance, now)
        out[at] = t.astype(np.int64)
    return out


class Bucket:
    """The seating of one bucket's words."""

    def __init__(self, number: int, pairs: bytes, contexts: bytes, trained: bytes, seated: list[bytes], prior: Prior, tables: bytes | None = None, parent_tables: bytes | None = None):
        self.number, self.prior = number, prior
        self.pairs, self.contexts = unpack(pairs).astype(np.int64), unpack(contexts).astype(np.int64)
        self.customers = unpack(trained).astype(np.int64)
        self.seated = _vector(seated)
        self.word = np.repeat(np.arange(len(self.pairs)), self.pairs)
        self.starts = np.cumsum(self.pairs) - self.pairs
        self.base = 1.0 / (prior.words + 1)
        self.tables = (self.customers > 0).astype(np.int64) if tables is None else unpack(tables).astype(np.int64)
        self.sum_tables()
        self.parent_tables = (self.parents > 0).astype(np.int64) if parent_tables is None else unpack(parent_tables).astype(np.int64)

    def sum_tables(self) -> None:
        self.parents = np.add.reduceat(self.tables, self.starts)

    def parent(self, sizes: Sizes) -> np.ndarray:
        d = self.prior.parent_discount
        new = (STRENGTH + d * sizes.parent_tables) * self.base
        return (self.parents - d * self.parent_tables + new) / (STRENGTH + sizes.customers)

    def sweep(self, rng: np.random.Generator, sizes: Sizes, tables: np.ndarray) -> tuple[Sizes, np.ndarray]:
        """Seats every dish anew; sizes and tables of the contexts as they were and as they are, what other buckets did since unseen."""
        d, top = self.prior.discount, self.prior.parent_discount
        many = np.flatnonzero(self.customers > 1)
        for half in (many[::2], many[1::2]):
            if len(half):
                own, word = self.tables[half], self.word[half]
                rest = self.parents[word] - own
                held = np.minimum(self.parent_tables[word], rest)
                new = np.full(len(half), (STRENGTH + top * sizes.parent_tables) * self.base)
                above = Parent(rest, held, sizes.customers - own, new, top)
                self.tables[half] = seat(self.customers[half], own, tables[self.contexts[half]] - own, above, d, rng)
                change = self.tables[half] - own
                tables = tables + np.bincount(self.contexts[half], change, len(tables)).astype(np.int64)
                self.sum_tables()
                was = int(self.parent_tables.sum())
                self.parent_tables = np.clip(self.parent_tables, np.minimum(self.parents, 1), self.parents)
                sizes = Sizes(sizes.customers + int(change.sum()), sizes.parent_tables + int(self.parent_tables.sum()) - was)
        many = np.flatnonzero(self.parents > 1)
        if len(many):
            own = self.parent_tables[many]
            none = np.zeros(len(many))
            above = Parent(none, none, none, np.full(len(many), self.base), 0.0, fixed=True)
            self.parent_tables[many] = seat(self.parents[many], own, sizes.parent_tables - own, above, top, rng)
            sizes = Sizes(sizes.customers, sizes.parent_tables + int((self.parent_tables[many] - own).sum()))
        return sizes, tables

    def places(self, words: bytes, own_words: bytes, own_pairs: bytes, own_contexts: bytes, names: bytes, own_names: bytes) -> np.ndarray:
        """Where the pairs of one part of a split bucket stand among the whole bucket's."""
        joint = self.word << 32 | self.contexts
        met = np.searchsorted(np.cumsum(unpack(names), dtype=np.uint64), np.cumsum(unpack(own_names), dtype=np.uint64))
        word = np.searchsorted(np.cumsum(unpack(words), dtype=np.uint64), np.cumsum(unpack(own_words), dtype=np.uint64))
        return np.searchsorted(joint, np.repeat(word, unpack(own_pairs).astype(np.int64)) << 32 | met[unpack(own_contexts).astype(np.int64)])

    def predict(self, sizes: Sizes, tables: np.ndarray) -> np.ndarray:
        """Probability of each pair's word in its context, under the present seating and its sizes."""
        d, customers = self.prior.discount, self.seated[self.contexts]
        parent = self.parent(sizes)[self.word]
        own = (self.customers - d * self.tables + (STRENGTH + d * tables[self.contexts]) * parent) / (STRENGTH + customers)
        return np.where(customers > 0, own, parent)


_SEATING = "tables binary, parent_tables binary"


def gibbs(rows: DataFrame, prior: Prior, start: Sizes, known_sizes: DataFrame, parts: int, rounds: int = ROUNDS, kept: int = KEPT, sweeps: int = SWEEPS) -> tuple[list[tuple[Prior, Sizes]], DataFrame]:
    """The discounts and sizes after each of the last rounds, and of each bucket its contexts' customers (seated) and, for each of those rounds,
    its contexts' tables (tables0, tables1 and so on) and its own seating (own0, parent0 and so on)."""
    sizes, seating, spark = start, None, rows.sparkSession
    now, states, out = known_sizes.select("bucket", F.col("tables0").alias("met")), [], known_sizes.select("bucket", "seated")
    schema = _sent_schema(["met"]) + f", {_SEATING}, fit array<double>"
    for k in range(rounds):
        known = spark.sparkContext.broadcast((prior, sizes))

        def run(batches, known=known, k=k):
            prior, sizes = known.value
            for batch in batches:
                for i in range(batch.num_rows):
                    number, pairs, contexts, trained, names, seated, met, own, parent = (batch.column(c)[i].as_py() for c in range(9))
                    bucket = Bucket(number, pairs, contexts, trained, seated, prior, own, parent)
                    rng, at, tables = np.random.default_rng([SEED, number, k]), sizes, _vector(met)
                    for _ in range(sweeps):
                        at, tables = bucket.sweep(rng, at, tables)
                    names = np.cumsum(unpack(names), dtype=np.uint64)
                    mine = np.bincount(bucket.contexts, bucket.tables, len(names)).astype(np.int64)
                    sums = (int(bucket.parents.sum()), int(bucket.parent_tables.sum()))
                    yield _batch([r | dict.fromkeys(("tables", "parent_tables", "fit")) for r in _sent(number, names, {"met": mine}, parts, sums)], ["met", "tables", "parent_tables", "fit"])
                    # the seating itself goes with no range
                    kept = {"bucket": number, "part": -1, "names": None, "customers": 0, "parent_tables_": 0, "met": None, "tables": pack(bucket.tables), "parent_tables": pack(bucket.parent_tables)}
                    fit = np.concatenate([seating_fit(bucket.customers, bucket.tables), seating_fit(bucket.parents, bucket.parent_tables)])
                    yield _batch([kept | {"fit": fit.tolist()}], ["met", "tables", "parent_tables", "fit"])

        whole = rows.select("bucket", "pairs", "contexts", "trained", "names").join(known_sizes.select("bucket", "seated"), "bucket").join(now, "bucket")
        if seating is None:
            whole = whole.withColumns({"tables": F.lit(None).cast("binary"), "parent_tables": F.lit(None).cast("binary")})
        else:
            whole = whole.join(seating, "bucket")
        done = store(whole.select("bucket", "pairs", "contexts", "trained", "names", "seated", "met", "tables", "parent_tables").mapInArrow(run, schema), "sweeps")
        found, sizes, rest = _added(done.where("part >= 0").drop("tables", "parent_tables", "fit"), ["met"])
        if len(rest):
            own, top = np.split(_fit_total(done), 2)
            top = top + restaurant_fit(np.array([sizes.parent_tables]))
            rng = np.random.default_rng([SEED, k])
            prior = prior._replace(discount=draw_discount(own + rest, rng), parent_discount=draw_discount(top, rng))
        seating, now = done.where("part < 0").select("bucket", "tables", "parent_tables"), store(found, "met")
        if k >= rounds - kept:
            n = len(states)
            states.append((prior, sizes))
            out = out.join(now.withColumnRenamed("met", f"tables{n}"), "bucket").join(seating.toDF("bucket", f"own{n}", f"parent{n}"), "bucket")
    return states, out


def _plus(total: tuple | None, more: tuple) -> tuple:
    """(sorted keys, and sums of each) of both, added up by key."""
    if total is None:
        return more
    keys = np.union1d(total[0], more[0])
    places = [np.searchsorted(keys, x[0]) for x in (total, more)]
    out = []
    for sums in zip(total[1:], more[1:]):
        both = np.zeros(len(keys))
        for at, values in zip(places, sums):
            both[at] += values
        out.append(both)
    return keys, *out


def _scores(rows: DataFrame, states: list[tuple[Prior, Sizes]], known_sizes: DataFrame) -> DataFrame:
    """doc_id, tokens, known, base, score of each document: sums over the buckets, exchanged packed by runs of GROUP documents.

    base: sum of log10(c + 1). Sums travel as they are, in doubles.
    """
    known = rows.sparkSession.sparkContext.broadcast(states)

    def run(batches):
        states = known.value
        for batch in batches:
            # the sums of the buckets so far by document: one bucket's come to them at a time
            total, named = None, {}
            for i in range(batch.num_rows):
                values = {n: batch.column(n)[i].as_py() for n in ("bucket", "pairs", "contexts", "trained", "seated", *(f"{c}{j}" for j in range(len(states)) for c in ("tables", "own", "parent")))}
                mean = 0.0
                for j, (prior, sizes) in enumerate(states):
                    bucket = Bucket(*(values[n] for n in ("bucket", "pairs", "contexts", "trained", "seated")), prior, values[f"own{j}"], values[f"parent{j}"])
                    mean = mean + bucket.predict(sizes, _vector(values[f"tables{j}"])) / len(states)
                seen = np.add.reduceat(bucket.customers, bucket.starts)
                base = np.repeat(np.log10(seen + 1), bucket.pairs)
                runs, documents, counts = (unpack(batch.column(k)[i].as_py()).astype(np.int64) for k in ("runs", "documents", "counts"))
                keys = np.cumsum(unpack(batch.column("keys")[i].as_py()), dtype=np.uint64)
                if batch.column("ids")[i].is_valid:
                    named.update(zip(keys.tolist(), _unpack_ids(batch.column("ids")[i].as_py())))
                was = np.repeat((seen > 0).astype(np.int64), bucket.pairs)
                if batch.column("words")[i].is_valid:
                    at = bucket.places(*(batch.column(k)[i].as_py() for k in ("words", "own_words", "own_pairs", "own_contexts", "names", "own_names")))
                    mean, base, was = mean[at], base[at], was[at]
                add = lambda x: np.bincount(documents, np.repeat(x, runs) * counts, len(keys))
                total = _plus(total, (keys, np.bincount(documents, counts, len(keys)), add(was), add(base), add(-np.log10(mean))))
            if total is None:
                continue
            keys, *sums = total
            sums = [np.rint(x).astype(np.uint64) for x in sums[:2]] + [x.view(np.uint64) for x in sums[2:]]
            group = keys // np.uint64(GROUP)
            cut = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(keys)]
            spans = list(zip(cut[:-1], cut[1:]))
            columns = [pa.array([int(group[a]) for a, _ in spans], pa.int64()), pa.array([pack(keys[a:b] % np.uint64(GROUP)) for a, b in spans], pa.binary())]
            columns += [pa.array([pack(x[a:b]) for a, b in spans], pa.binary()) for x in sums]
            own = [[k for k in keys[a:b].tolist() if k in named] for a, b in spans]
            columns.append(pa.array([pack(np.array(k, np.uint64) % np.uint64(GROUP)) if k else None for k in own], pa.binary()))
            columns.append(pa.array([_pack_ids([named[x] for x in k]) if k else None for k in own], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["group", "keys", "tokens", "known", "base", "score", "named", "ids"])

    def add_up(part: pa.Table) -> pa.Table:
        found = part.to_pylist()
        sums = np.zeros((4, GROUP))
        ids: dict[int, int | None] = {}
        for row in found:
            at = unpack(row["keys"]).astype(np.int64)
            if row["ids"] is not None:
                ids.update(zip(unpack(row["named"]).astype(np.int64).tolist(), _unpack_ids(row["ids"])))
            for k, name in enumerate(("tokens", "known", "base", "score")):
                sums[k, at] += unpack(row[name]).view(np.float64) if k > 1 else unpack(row[name])
        at = np.array(sorted(ids), np.int64)
        out = [pa.array([ids[k] for k in at.tolist()], pa.int64()), *(pa.array(sums[k, at].astype(np.int64)) for k in (0, 1)), *(pa.array(sums[k, at]) for k in (2, 3))]
        return pa.table(out, names=["doc_id", "tokens", "known", "base", "score"])

    sent = rows.join(known_sizes, "bucket").mapInArrow(run, "group bigint, keys binary, tokens binary, known binary, base binary, score binary, named binary, ids binary")
    return sent.groupBy("group").applyInArrow(add_up, "doc_id bigint, tokens bigint, known bigint, base double, score double")


def score_documents(docs: DataFrame, rounds: int = ROUNDS, kept: int = KEPT, sweeps: int = SWEEPS, bucket_bytes: int = BUCKET_BYTES, chunk: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity; one row per row of docs (doc_id, text).

    The model learns from the rows that are not held out (a null doc_id is not). Each text ends with an end token, so
    a null or empty text has one token. Repeated rows count as often as they stand and score alike. Other columns are
    ignored. Without training rows every token is unknown and has probability 1. An empty table gives an empty table;
    a text of any length is scored whole. Words are known by 64-bit hashes. bucket_bytes of text give one bucket; chunk tokens
    are packed at a time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    amount = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(max(1, amount // bucket_bytes))
    # a row's key is its place in this one scan; it comes back with the row's doc_id, so no second scan must agree with it
    parts = rows.select(F.monotonically_increasing_id().alias("key"), ~held_out(F.col("doc_id")), "doc_id", "text").mapInArrow(
        lambda batches: _chunks(batches, n, chunk), "bucket int, salt int, words binary, runs binary, contexts binary, names binary, documents binary, counts binary, keys binary, train binary, ids binary"
    )
    path = new_path(spark, "restaurants")
    parts.groupBy("bucket", "salt").applyInArrow(_merge, _BUCKET).write.parquet(path)
    table = spark.read.schema(_BUCKET).parquet(path)
    restaurants, scored = _restaurant_rows(table)
    ranges = max(1, n // PART)
    prior, start, sizes = prior_of(restaurants, ranges)
    states, sizes = gibbs(restaurants, prior, start, sizes, ranges, rounds, kept, sweeps)
    sums = _scores(scored, states, sizes)
    return sums.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(prior.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("tokens") * F.lit(float(np.log10(prior.tokens + prior.words + 1)))).alias("base_score"),
        (-F.col("score")).alias("score"),
        F.pow(F.lit(10.0), F.col("score") / F.col("tokens")).alias("perplexity"),
    )
