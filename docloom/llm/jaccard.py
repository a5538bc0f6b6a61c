"""Operator 1: n-gram Jaccard join with token-combination prefixes.

A document's tokens are its distinct word shingles. Tokens are ordered rare class before frequent class, then by hash.
Sets of Jaccard similarity t or more miss at most n - ceil(t n) of either's tokens; a prefix with more signatures than misses
can destroy shares one with every partner. A rare token is a signature by itself. Frequent tokens are indexed as
combinations of two within a part of their class (parts by hash, their number by set size), and the prefix is
extended: c tokens of a part give c - 1 that no fewer misses destroy. Signatures shared by few sets give all their pairs;
one shared by many gives links to its most common member, and what stays apart from the rest of such a family is
compared with all of it in blocks. Every link comes from exact verification.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.components import components
from docloom.llm.words import buckets, deltas, mix, pack, release, shingle_sets, unpack
from docloom.session import small, store

#: A token of more documents than this is frequent; signatures of at most so many sets give all pairs.
RARE = 24
#: Bits of the filter of frequent tokens for each of them, its most bits in all, and its hashes. A filter never misses a frequent
#: token; a fuller one takes more rare ones for frequent, which costs them combinations and loses nothing.
TOKEN_BITS, MOST_BITS, HASHES = 16, 1 << 29, 4
#: Tokens counted in one exchange row's chunk, input bytes a counting bucket, tokens a block of the exact comparison.
CHUNK, BUCKET_BYTES, BLOCK = 1_500_000, 12 << 20, 50_000
#: What a set weighs in a block beside its tokens, so that blocks of short sets stay small too.
SET = 16
#: Ranges that signatures and token counts are dealt to at least, and pairs of sets that a Python batch holds at most.
BUCKETS, PAIRS = 64, 256


class Frequent:
    """A Bloom filter of tokens, in as many slices of equal size as the tokens' key space has ranges."""

    def __init__(self, slices: list[bytes], bits: int):
        self.bits, self.n = bits, len(slices)
        self.data = np.frombuffer(b"".join(slices), np.uint8)

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        one, two = mix(keys), mix(keys + np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
        for k in range(HASHES):
            yield ((one + np.uint64(k) * two) >> np.uint64(16)) % np.uint64(bits)

    @staticmethod
    def slice_of(keys: np.ndarray, bits: int) -> bytes:
        data = np.zeros(bits, np.uint8)
        for at in Frequent.places(keys, bits):
            data[at.astype(np.int64)] = 1
        return np.packbits(data).tobytes()

    def has(self, keys: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros(len(keys), bool)
        first = buckets(keys, self.n) * (self.bits // 8)
        found = np.ones(len(keys), bool)
        for at in self.places(keys, self.bits):
            at = at.astype(np.int64)
            found &= (self.data[first + (at >> 3)] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return found


def frequent_tokens(docs: DataFrame, size: int, n: int, rare: int = RARE) -> Frequent:
    """The filter of tokens (by their 48-bit prefixes) in more than `rare` documents, counted over all of them (copies once a chunk).

    Tasks count their own tokens first and exchange packed counts by ranges of the key, so a token of every document
    costs one entry a task. Frequent tokens stay in a table by range; each range makes its slice of the filter, whose size
    goes by their number up to a fixed bound.
    """

    def count(batches):
        def flush(held):
            keys, counts = np.unique(np.concatenate(held) >> np.uint64(16), return_counts=True)
            at = np.searchsorted(buckets(keys, n), np.arange(n + 1))
            spans = [(b, at[b], at[b + 1]) for b in range(n) if at[b + 1] > at[b]]
            return pa.RecordBatch.from_arrays(
                [pa.array([b for b, _, _ in spans], pa.int32()), pa.array([pack(deltas(keys[i:j])) for _, i, j in spans], pa.binary()), pa.array([pack(counts[i:j]) for _, i, j in spans], pa.binary())],
                ["bucket", "keys", "counts"],
            )

        held, total, met = [], 0, set()
        for batch in batches:
            for _, tokens in shingle_sets(batch.column(0), size):
                own = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
                if own in met:  # a copy of a set of this chunk
                    continue
                met.add(own)
                held.append(tokens)
                total += len(tokens)
                if total >= CHUNK:
                    yield flush(held)
                    held, total, met = [], 0, set()
        if total:
            yield flush(held)
        del held, met
        release()

    def reduce(part: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.cumsum(unpack(x), dtype=np.uint64) for x in part["keys"]])
        counts = np.concatenate([unpack(x) for x in part["counts"]]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        df = np.add.reduceat(counts, first) if len(first) else counts
        return pd.DataFrame({"bucket": part["bucket"].iloc[0], "token": keys[first][df > rare].astype(np.int64)})

    counted = docs.select("text").mapInArrow(count, "bucket int, keys binary, counts binary")
    found = store(counted.groupBy("bucket").applyInPandas(reduce, "bucket int, token bigint"), "frequent")
    total = found.count()
    if not total:
        return Frequent([], 8)
    bits = max(8, min(TOKEN_BITS * total, MOST_BITS) // n // 8 * 8)
    filled = found.groupBy("bucket").applyInPandas(lambda part: pd.DataFrame({"bucket": part["bucket"][:1], "data": [Frequent.slice_of(part["token"].to_numpy(np.int64).astype(np.uint64), bits)]}), "bucket int, data binary")
    slices = {r["bucket"]: bytes(r["data"]) for r in filled.collect()}  # MOST_BITS at most
    return Frequent([slices.get(b, bytes(bits // 8)) for b in range(n)], bits)


def _levels(n: int, percent: int) -> range:
    """Size levels (powers of two) of all partners of a set of n tokens."""
    return range((-(-percent * n // 100)).bit_length() - 1, (100 * n // percent).bit_length())


def signatures(tokens: np.ndarray, frequent: Frequent, percent: int) -> tuple[np.ndarray, int]:
    """(signatures, rare tokens) of a sorted set."""
    n = len(tokens)
    if not n:
        return tokens, 0
    misses = n - -(-percent * n // 100)
    common = frequent.has(tokens >> np.uint64(16))
    single, many = tokens[~common], tokens[common]
    if len(single) > misses or n == 1:
        return single[: misses + 1], len(single)
    out = [single]
    for level in _levels(n, percent):
        parts = max(1, int(0.01 * (100 - percent) * 2**level / 8))
        part = ((mix(many) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
        fresh = np.zeros(len(many), bool)
        fresh[np.unique(part, return_index=True)[1]] = True
        gained = len(single) + np.arange(1, len(many) + 1) - np.cumsum(fresh)
        end = int(np.searchsorted(gained, misses + 1)) + 1
        chosen, part = many[:end], part[:end]
        order = np.argsort(part, kind="stable")
        chosen, part = chosen[order], part[order]
        edges = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
        for i, j in zip(edges[:-1], edges[1:]):
            if j - i > 1:
                x, y = np.triu_indices(j - i, 1)
                out.append(mix(mix(chosen[i:j][x] + np.uint64(level)) + chosen[i:j][y]))
    return np.unique(np.concatenate(out)), len(single)


def _keyed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (set size), key (a 128-bit hash of the set; null where it is empty)."""

    def keys(batches):
        for batch in batches:
            n, keys = [], []
            for _, tokens in shingle_sets(batch.column(1), size):
                n.append(len(tokens))
                keys.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "n", "key"])

    return docs.select("doc_id", "text").mapInArrow(keys, "doc_id bigint, n bigint, key binary")


def _candidates(docs: DataFrame, size: int, frequent: Frequent, percent: int, n: int, rare: int) -> DataFrame:
    """many, a, b, an, bn: pairs that share a signature, each once a bucket.

    A signature of at most `rare` sets gives all its pairs of similar sizes. One of more (many) gives each set (a) with the
    signature's leader (b), the set with the fewest rare tokens: in a family of copies, the text they vary. Signatures travel
    packed by ranges of their hash; copies within a chunk send theirs once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def sign(batches):
        def flush():
            sigs = np.concatenate([x for x, _ in held]) >> np.uint64(16)
            at = np.repeat(np.arange(len(held), dtype=np.uint64), [len(x) for x, _ in held])
            order = np.argsort(sigs, kind="stable")
            sigs, at = sigs[order], at[order]
            cut = np.searchsorted(buckets(sigs, n), np.arange(n + 1))
            spans = [(b, cut[b], cut[b + 1]) for b in range(n) if cut[b + 1] > cut[b]]
            facts = [pack(np.array([x[k] for _, x in held], np.int64).view(np.uint64)) for k in range(3)]
            columns = [pa.array([b for b, _, _ in spans], pa.int32()), pa.array([pack(deltas(sigs[i:j])) for _, i, j in spans], pa.binary()), pa.array([pack(at[i:j]) for _, i, j in spans], pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([f] * len(spans), pa.binary()) for f in facts)], ["bucket", "sigs", "at", "docs", "n", "rare"])

        common = shared.value
        held, total, met = [], 0, set()
        for batch in batches:
            own = batch.column(0).to_pylist()
            for row, tokens in shingle_sets(batch.column(1), size):
                digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
                if own[row] is None or not len(tokens) or digest in met:
                    continue
                met.add(digest)
                found, singles = signatures(tokens, common, percent)
                held.append((found, (own[row], len(tokens), singles)))
                total += len(found)
                if total >= CHUNK:
                    yield flush()
                    held, total, met = [], 0, set()
        if total:
            yield flush()
        held, met = [], set()
        release()

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        sig = np.concatenate([np.cumsum(unpack(x), dtype=np.uint64) for x in part["sigs"]])
        at = [unpack(x).astype(np.int64) for x in part["at"]]
        doc, size_, singles = (np.concatenate([unpack(x).view(np.int64)[i] for x, i in zip(part[c], at)]) for c in ("docs", "n", "rare"))
        # most signatures are met once: they go before anything is sorted by more
        order = np.argsort(sig, kind="stable")
        same = sig[order][1:] == sig[order][:-1]
        order = order[np.r_[same, False] | np.r_[False, same]] if len(order) else order
        sig, doc, size_, singles = sig[order], doc[order], size_[order], singles[order]
        order = np.lexsort((doc, singles, sig))
        sig, doc, size_ = sig[order], doc[order], size_[order]
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
        count = np.diff(np.r_[first, len(sig)])
        group = np.repeat(np.arange(len(first)), count)
        out = []

        def add(i, j, many):
            keep = doc[i] != doc[j]
            if not many:
                keep &= (100 * size_[i] >= percent * size_[j]) & (100 * size_[j] >= percent * size_[i])
                i, j = np.where(doc[i] < doc[j], i, j), np.where(doc[i] < doc[j], j, i)
            i, j = i[keep], j[keep]
            if len(i):
                rows = pd.DataFrame({"many": many, "a": doc[i], "b": doc[j], "an": size_[i], "bn": size_[j]})
                out.append(rows.drop_duplicates())

        few = np.flatnonzero(count[group] <= rare) if len(group) else group
        for step in range(1, rare):
            few = few[few + step < len(sig)]
            some = few[group[few] == group[few + step]]
            if not len(some):
                break
            add(some, some + step, False)
        large = np.flatnonzero(count[group] > rare) if len(group) else group
        add(large, first[group[large]], True)
        empty = pd.DataFrame({"many": np.zeros(0, bool), **{c: np.zeros(0, np.int64) for c in ("a", "b", "an", "bn")}})
        found = pd.concat(out).drop_duplicates() if out else empty
        del sig, at, doc, size_, singles, order, group, few, large
        release()
        return found

    packed = docs.select("doc_id", "text").mapInArrow(sign, "bucket int, sigs binary, at binary, docs binary, n binary, rare binary")
    return packed.groupBy("bucket").applyInPandas(meet, "many boolean, a bigint, b bigint, an bigint, bn bigint")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """doc, key, tokens (packed, 48 bits each) of the wanted (doc, key); a doc_id with several texts has several keys."""

    def sets(batches):
        for batch in batches:
            ids, keys, out = [], [], []
            own = batch.column(0).to_pylist()
            for row, tokens in shingle_sets(batch.column(1), size):
                ids.append(own[row])
                keys.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                out.append(pack(deltas(np.unique(tokens >> np.uint64(16)))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(out, pa.binary())], ["doc", "key", "tokens"])

    # wanted is read from a table, so it is counted and hinted before the texts are met
    rows = docs.select("doc_id", "text").join(small(wanted.select(F.col("doc").alias("doc_id")).distinct()), "doc_id", "left_semi")
    found = rows.mapInArrow(sets, "doc bigint, key binary, tokens binary")
    # rows that repeat both id and text give a set twice, which only repeats links
    return found.join(small(wanted), ["doc", "key"], "left_semi").drop("key")


def _tokens(packed: pa.Scalar) -> np.ndarray:
    return np.cumsum(unpack(packed.as_py()), dtype=np.uint64)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def verify(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                both = np.concatenate([_tokens(x), _tokens(y)])
                both.sort()
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * same >= percent * (len(both) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = sets.toDF("a", "x"), sets.toDF("b", "y")
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(verify, "a bigint, b bigint")


def _similar_sizes(percent: int, x: str, y: str):
    return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)


def _blocks(family: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between sets of one family and different components; one for each set and component met in a block.

    family: doc, family, component, n. Only pairs with a set outside the family's largest component are compared, so what
    is already linked costs nothing. Blocks hold BLOCK to twice as many tokens at most; a pair of blocks is multiplied as incidence
    matrices, a slice of their common tokens at a time.
    """
    sizes = family.groupBy("family", "component").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("family").agg(F.max(F.struct("c", "component")).alias("m"), F.count(F.lit(1)).alias("parts"))
    rows = store(family.join(main.where("parts > 1").select("family", F.col("m.component").alias("main")), "family"), "families")

    def blocked(part: DataFrame, side: str) -> DataFrame:
        # sizes are added up before they are numbered, so no task meets a family's members; a size of more tokens than
        # a block holds is dealt to blocks of its own by hash
        totals = part.groupBy("family", "n").agg(F.sum(F.col("n") + SET).alias("total"))
        w = Window.partitionBy("family").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.withColumn("block", F.floor(F.coalesce(F.sum("total").over(w), F.lit(0)) / BLOCK))
        totals = store(totals.withColumns({"own": F.when(F.col("total") > BLOCK, F.col("n")).otherwise(0), "deal": F.ceil(F.col("total") / BLOCK)}), "totals")
        numbered = part.join(small(totals.drop("total")), ["family", "n"])
        numbered = numbered.withColumn("deal", F.when(F.col("own") > 0, F.pmod(F.xxhash64("doc"), "deal")).otherwise(0))
        name = F.struct("family", "block", "own", "deal").alias(f"{side}b")
        item = F.struct("doc", "component", "tokens")
        found = numbered.join(sets, "doc").groupBy(name).agg(F.collect_list(item).alias(side), F.min("n").alias(f"{side}l"), F.max("n").alias(f"{side}h"))
        return store(found, "blocks").withColumn("family", F.col(f"{side}b.family"))

    apart, whole = blocked(rows.where("component <> main"), "x"), blocked(rows, "y")
    near = (F.col("xh") * 100 >= F.col("yl") * percent) & (F.col("yh") * 100 >= F.col("xl") * percent)
    # pairs of blocks are made by name, then each side's sets come by the block's name: a family spreads over tasks
    names = store(apart.drop("x").join(whole.drop("y"), "family").where(near).select("xb", "yb"), "names")
    both = names.join(apart.select("xb", "x"), "xb").join(whole.select("yb", "y"), "yb").select("x", "y")

    def sides(column: pa.Array, i: int):
        items = column[i].values
        sets_ = [_tokens(t) for t in items.field("tokens")]
        return items.field("doc").to_numpy(), items.field("component").to_numpy(), np.array([len(t) for t in sets_]), sets_

    def compare(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                xd, xc, xn, xs = sides(batch.column(0), i)
                yd, yc, yn, ys = sides(batch.column(1), i)
                words = np.intersect1d(np.unique(np.concatenate(xs)), np.unique(np.concatenate(ys)), assume_unique=True)
                same = np.zeros((len(xs), len(ys)), np.float32)

                def incidence(sets_, some):
                    m = np.zeros((len(sets_), len(some)), np.float32)
                    for r, s in enumerate(sets_):
                        at = np.searchsorted(some, s)
                        m[r, at[(at < len(some)) & (some[np.minimum(at, len(some) - 1)] == s)]] = 1
                    return m

                for j in range(0, len(words), 8192):
                    same += incidence(xs, words[j : j + 8192]) @ incidence(ys, words[j : j + 8192]).T
                linked = (100 * same >= percent * (xn[:, None] + yn[None, :] - same)) & (xc[:, None] != yc[None, :])
                met = {(xd[r], yc[c]): yd[c] for r, c in zip(*np.nonzero(linked))}
                out += [(a, b) for (a, _), b in met.items()]
            yield pa.RecordBatch.from_arrays([pa.array([int(v[k]) for v in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return both.mapInArrow(compare, "a bigint, b bigint")


def _in_small_batches(df: DataFrame, name: str) -> DataFrame:
    """store() with Python batches of few rows, for rows that carry whole sets."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(PAIRS))
    try:
        return store(df, name)
    finally:
        conf.set(key, before)


def similar_documents(docs: DataFrame, size: int = 4, percent: int = 85, rare: int = RARE) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per row of docs (doc_id, text; other columns are ignored).

    Two documents link when 100 x intersection >= percent x union of their sets of `size`-word shingles. A null or empty
    text, or one without words, has an empty set and links with nothing; a text of any length has its whole set. component_id
    is the smallest doc_id reachable by links. Rows that repeat a doc_id stand for one node with all their texts; rows without
    a doc_id get no component. An empty table gives an empty table. Equal sets are one class from the start, so exact copies
    never meet as pairs; links have no order, so there are no ties.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    amount = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(max(BUCKETS, amount // BUCKET_BYTES))
    keyed = store(_keyed(docs, size), "keyed")
    usable = keyed.where("doc_id IS NOT NULL AND key IS NOT NULL").select("doc_id", "key")
    classes = store(usable.groupBy("key").agg(F.min("doc_id").alias("class")), "classes")
    rows = store(usable.join(small(classes), "key").select("doc_id", "class").distinct(), "rows")
    # a doc_id of several texts ties their classes together
    several = rows.groupBy("doc_id").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high")
    ties = rows.join(several, "doc_id").select(F.col("low").alias("a"), F.col("class").alias("b")).where("a <> b")
    frequent = frequent_tokens(docs, size, n, rare)
    met = store(_candidates(docs, size, frequent, percent, n, rare), "met")
    named = small(rows)
    met = met.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b").where("x <> y")
    met = store(met.select("many", F.col("x").alias("a"), F.col("y").alias("b"), "an", "bn").distinct(), "met")
    many = met.where("many").select(F.col("a").alias("doc"), F.col("an").alias("n"), F.col("b").alias("lead"), F.col("bn").alias("ln"))
    near = met.where(_similar_sizes(percent, "an", "bn"))
    pairs = store(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    met = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc")))
    met = met.unionByName(many.select("doc")).unionByName(many.select(F.col("lead").alias("doc"))).distinct()
    wanted = store(met.join(classes.withColumnRenamed("class", "doc"), "doc"), "wanted")
    sets = store(_sets(docs, wanted, size), "sets")
    links = _in_small_batches(_verify(pairs, sets, percent).unionByName(ties), "links")
    found = components(links)
    # families: sets that share a signature of many; what is not of one component there is compared exactly
    family = components(many.select(F.col("doc").alias("a"), F.col("lead").alias("b")))
    whole = family.select(F.col("node").alias("doc"), F.col("component").alias("family")).unionByName(family.select(F.col("component").alias("doc"), F.col("component").alias("family")).distinct())
    sizes = many.select("doc", "n").unionByName(many.select(F.col("lead").alias("doc"), F.col("ln").alias("n"))).groupBy("doc").agg(F.max("n").alias("n"))
    whole = whole.join(found.withColumnRenamed("node", "doc"), "doc", "left").join(sizes, "doc")
    whole = store(whole.select("doc", "family", F.coalesce("component", "doc").alias("component"), "n"), "whole")
    more = _in_small_batches(_blocks(whole, sets, percent), "more")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    named = rows.groupBy("doc_id").agg(F.min("class").alias("class"))
    labels = found.select(F.col("node").alias("class"), "component")
    named = named.join(small(labels), "class", "left").select("doc_id", F.coalesce("component", "class").alias("component_id"))
    out = keyed.select("doc_id", F.col("n").alias("n_shingles")).join(small(store(named, "named")), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs less all but the smallest doc_id of each component; rows without a doc_id stay. All columns of docs.

    Rows that repeat a kept doc_id all stay: they are one document.
    """
    found = similar_documents(docs, size, percent)
    gone = store(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
