"""Operator 3: benchmark decontamination by size-partitioned MinHash containment search.

Short test items are searched inside long documents. A test item's sketch holds its smallest shingle hashes (a bottom
sketch, the MinHash of the item alone); what a document contains of the sketch estimates the item's containment in
the document, however long that is. Items are partitioned by size, and each partition's sketch is as long as its
largest item needs: an item of m shingles with containment t or more misses at most m - ceil(t m) of its shingles, so
of a sketch of twice that many plus 1 at least that many plus 1 are in the document. The search so loses no pair.

Documents are probed with the sketches alone, and only by hashes that are small enough for one. The pairs found are
verified on the words: of the documents found, every shingle is compared as text with those of the items found in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import small, store

SHINGLE, LEAST = 5, 0.8
#: Largest item size of each partition, in shingles; the last is open.
SIZES = [8, 16, 32, 64, 128, 256, 512, 1024]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased, cut at ASCII white space; null: none."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(found: Column, size: int) -> Column:
    """Hashes of every run of so many words, in order; fewer words: none."""
    # transform over an array of one binds the hashed words, which a lambda would else compute again for each run
    hashed = F.array(F.transform(found, lambda w: F.xxhash64(w)))

    def runs(h: Column) -> Column:
        if size == 1:
            return h
        firsts = F.slice(h, F.lit(1), F.size(h) - size + 1)
        return F.transform(firsts, lambda _, i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))

    return F.transform(hashed, lambda h: F.when(F.size(h) >= size, runs(h)).otherwise(F.array().cast("array<bigint>")))[0]


def _misses(m: Column, least: float) -> Column:
    """The most shingles of m that an item may miss: m - ceil(least m), in whole numbers."""
    return (m - F.ceil((m * round(least * 1000)) / 1000.0)).cast("int")


def _grams(found: Column, size: int) -> Column:
    """Runs of so many words as text, in order; fewer words: none."""
    runs = F.transform(F.sequence(F.lit(1), F.size(found) - size + 1), lambda i: F.array_join(F.slice(found, i, size), " "))
    return F.when(F.size(found) >= size, runs).otherwise(F.array().cast("array<string>"))


def item_index(benchmark: DataFrame, least: float = LEAST, size: int = SHINGLE) -> DataFrame:
    """item_id, item, width, m, part, need, sketch, grams: a row per item. part: its size partition, by its largest size; sketch:
    its smallest hashes, as many as the partition needs; need: how many of them a document that holds the item must hold.

    An item of 1 to size - 1 words is one shingle of its own width. Items without words, null ids and texts
    have no rows; repeated items count once, and an item id with several texts gives an item per text.
    """
    found = benchmark.select(F.col("item_id").cast("bigint"), words(F.col("text")).alias("w")).where("item_id IS NOT NULL AND size(w) > 0")
    width = F.least(F.size("w"), F.lit(size))
    by_width = lambda make: F.coalesce(*[F.when(width == k, F.array_distinct(make(F.col("w"), k))) for k in range(1, size + 1)])
    one = found.select("item_id", width.alias("width"), F.array_sort(by_width(shingles)).alias("h"), F.array_sort(by_width(_grams)).alias("grams"))
    one = one.groupBy("item_id", "width", "grams").agg(F.min("h").alias("h"))
    m = F.size("grams")
    part = F.coalesce(*[F.when(m <= s, F.lit(s)) for s in SIZES], m)
    one = one.withColumns({"m": m, "part": part, "take": 2 * _misses(part, least) + 1, "item": F.xxhash64("item_id", "grams")})
    # the partition's sketch may be longer than the item, or than the item's own need
    one = one.withColumn("sketch", F.slice("h", F.lit(1), F.col("take")))
    need = F.greatest(F.lit(1), F.size("sketch") - _misses(F.col("m"), least))
    return one.select("item_id", "item", "width", "m", "part", need.alias("need"), "sketch", "grams")


def search(docs: DataFrame, index: DataFrame) -> DataFrame:
    """doc_id, item: the pairs whose document holds enough of the item's sketch. No other shingle of an item is looked up."""
    sketches = store(index.select("item", "width", "need", F.explode("sketch").alias("hash")), "sketches")
    # one row a width (at most SHINGLE of them), from the benchmark alone
    widths = sorted(sketches.groupBy("width").agg(F.max("hash")).collect())
    found = docs.select("doc_id", words(F.col("text")).alias("w"))
    hits = None
    for k, top in widths:
        runs = F.filter(shingles(F.col("w"), k), lambda h: h <= F.lit(top))  # noqa: B023
        met = found.select("doc_id", F.explode(F.array_distinct(runs)).alias("hash"))
        met = met.join(small(sketches.where(F.col("width") == k)), "hash").select("doc_id", "item", "need", "hash")
        hits = met if hits is None else hits.unionByName(met)
    if hits is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item bigint")
    # a document's shingles are distinct already, unless its id repeats
    once = hits.groupBy("doc_id", "item", "need", "hash").agg(F.lit(1).alias("n"))
    return once.groupBy("doc_id", "item", "need").agg(F.sum("n").alias("seen")).where("seen >= need").select("doc_id", "item")


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, size: int = SHINGLE) -> DataFrame:
    """doc_id, item_id, hits, m, containment: each pair whose document holds at least that share of the item's shingles.

    Documents with no words, and null ids, hold nothing; texts of any length are searched whole. Rows that repeat a
    doc_id count as one document; a pair of an item id with several texts is told by the best of them. An empty table
    of either kind gives an empty table; other columns are ignored, whatever their names. The index grows with
    the benchmark, not with the corpus; it is broadcast only if its size is within the bound.
    """
    index = store(item_index(benchmark, least, size), "items")
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = store(search(rows, index), "found")
    # the documents found, each with its items; a document's list is at most the benchmark's
    wanted = store(found.groupBy("doc_id").agg(F.collect_set("item").alias("items")), "wanted")
    texts = rows.join(small(wanted), "doc_id").select("doc_id", "items", words(F.col("text")).alias("w"))
    grams = index.select("item", "item_id", "m", "width", F.explode("grams").alias("gram"))
    hits = None
    for (k,) in sorted(index.select("width").distinct().collect()):
        runs = texts.select("doc_id", "items", F.explode(F.array_distinct(_grams(F.col("w"), k))).alias("gram"))
        met = runs.join(small(grams.where(F.col("width") == k)), "gram").where(F.array_contains("items", F.col("item")))
        met = met.select("doc_id", "item_id", "item", "m", "gram")
        hits = met if hits is None else hits.unionByName(met)
    if hits is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, hits bigint, m int, containment double")
    once = hits.groupBy("doc_id", "item_id", "item", "m", "gram").agg(F.lit(1).alias("n"))
    pairs = once.groupBy("doc_id", "item_id", "item", "m").agg(F.sum("n").alias("hits"))
    kept = pairs.where(F.col("hits") * 1000 >= F.col("m") * round(least * 1000))
    kept = kept.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("hits") / F.col("m"), "hits", "m")).alias("x"))
    return kept.select("doc_id", "item_id", F.col("x.hits").alias("hits"), F.col("x.m").alias("m"), F.col("x.col1").alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, size: int = SHINGLE) -> DataFrame:
    """The rows of docs that hold no test item, with all columns of docs, whatever their names.

    Rows with a null doc_id stay, as do null and empty texts; rows that repeat a doc_id go or stay together, and whole
    texts of any length count. An empty table stays empty, and an empty benchmark takes nothing out.
    """
    bad = store(find_leaks(docs, benchmark, least, size).select("doc_id").distinct(), "leaks")
    return docs.join(small(bad), "doc_id", "left_anti").select(*docs.columns)
