"""Operator 10: sharding by a hierarchical weighted hash tree.

A row descends region -> rack -> shard. At each node every child draws ln(u) / weight, where u in (0, 1) is a hash
of the row's key and the child's name, and the largest draw wins. A node's weight is the sum of the weights below it.
Raising one weight changes only that node's draws (and its ancestors'), so rows move only into the subtrees whose
weight rose; a shard added in a region of its own takes rows into itself alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.session import fresh, small, store

#: (region, rack, shard, weight)
Leaf = tuple[str, str, int, float]


def even_tree(shards: int, regions: int = 4, racks: int = 2) -> list[Leaf]:
    """Shards of weight 1, dealt over so many regions and racks in each; rows are name, name, number, weight."""
    return [(f"region{s % regions}", f"rack{s // regions % racks}", s, 1.0) for s in range(shards)]


def grow(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region of its own, so that only it gains rows."""
    new = max(leaf[2] for leaf in tree) + 1
    return [*tree, (f"region-of-{new}", "rack0", new, weight)]


def _draw(key: Column, name: Column, weight: Column) -> Column:
    # xxhash64 of the key and the child's path; the top 53 bits make a double strictly between 0 and 1
    bits = F.shiftrightunsigned(F.xxhash64(key, name), 11)
    return F.log((bits.cast("double") + 0.5) / F.lit(float(2**53))) / weight


def tree_shard(key: Column, tree: list[Leaf]) -> Column:
    """The shard of a key (bigint; null is a key like any other). Children of weight 0 draw nothing.

    The tree is a constant array: a node's children with their paths and weights, and the child's node (a leaf's: its shard).
    """
    tree = [leaf for leaf in tree if leaf[3] > 0]
    if not tree:
        raise ValueError("no shard has a weight")
    paths = ["", *sorted({f"/{a}" for a, *_ in tree}), *sorted({f"/{a}/{b}" for a, b, *_ in tree})]
    children: dict[str, dict[str, tuple[int, float]]] = {p: {} for p in paths}
    for region, rack, shard, weight in tree:
        steps = ["", f"/{region}", f"/{region}/{rack}", f"/{region}/{rack}/{shard}"]
        for above, below in zip(steps, steps[1:]):
            node = paths.index(below) if below in children else shard
            children[above][below] = (node, children[above].get(below, (0, 0.0))[1] + weight)
    child = lambda name, node, weight: F.struct(F.lit(name).alias("name"), F.lit(node).alias("node"), F.lit(weight).alias("weight"))
    nodes = F.array(*[F.array(*[child(name, *children[p][name]) for name in sorted(children[p])]) for p in paths])
    at = F.lit(0)
    for _ in range(3):
        draws = F.transform(F.get(nodes, at), lambda c: F.struct(_draw(key, c["name"], c["weight"]).alias("draw"), c["node"].alias("node")))
        at = F.array_max(draws)["node"]
    return at.cast("int")


def number_rows(df: DataFrame, group: str, order: list[str], name: str = "slot") -> DataFrame:
    """Gapless numbers from 0 within each group, in the given order, without a task per group.

    Rows are dealt by ranges of (group, order), so a group of any size spreads over many tasks; each range is
    numbered by itself and starts where the counts of the ranges before it end. Rows equal in every order column
    lie in one range and get any of their numbers.
    """
    part = fresh("part", df.columns)
    ranged = store(df.repartitionByRange(*[F.col(c) for c in (group, *order)]).withColumn(part, F.spark_partition_id()), "ranged")
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(group, part).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(F.col(group).alias("g"), F.col(part).alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    joined = ranged.join(small(starts), ranged[group].eqNullSafe(F.col("g")) & (ranged[part] == F.col("p")))
    within = Window.partitionBy(group, part).orderBy(*order)
    return joined.withColumn(name, F.col("start") + F.row_number().over(within) - 1).drop("g", "p", "start", part)


def shard_documents(docs: DataFrame, shards: int = 40, tree: list[Leaf] | None = None, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, one row per row of docs; with keep, all columns of docs besides,
    and clashing names of ours get an underscore.

    The law is ``key``: only doc_id and the tree decide. size is the text's UTF-8 bytes plus 16 (null text: 16, with
    the crc32 of no bytes, 0), whatever its length. A null doc_id is a key of its own. Repeated rows share a shard and get slots
    of their own, in any order; slots go by doc_id, crc32 and size. An empty table gives an empty table. Without keep other
    columns are ignored, whatever their names; with it whole rows travel to their shards' ranges, as writing shards needs.
    """
    tree = tree or even_tree(shards)
    id_, body = F.col(key).cast("bigint"), F.coalesce(F.col(text), F.lit(""))
    made = {
        "doc_id": id_,
        "size": F.octet_length(body).cast("bigint") + 16,
        "text_crc32": F.crc32(F.encode(body, "UTF-8")),
        "law": F.lit("key"),
        "shard": tree_shard(id_, tree),
        "grown_shard": tree_shard(id_, grow(tree)),
    }
    if keep:
        del made["doc_id"]
    named = {n: fresh(n, docs.columns if keep else []) for n in (*made, "slot")}
    rows = docs.withColumns({named[n]: c for n, c in made.items()}) if keep else docs.select(*[c.alias(n) for n, c in made.items()])
    out = number_rows(rows, named["shard"], [key if keep else "doc_id", named["text_crc32"], named["size"]], named["slot"])
    out = out.withColumn(named["slot"], F.col(named["slot"]).cast(T.LongType()))
    ours = [named[n] for n in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")]
    return out.select(*(docs.columns if keep else ["doc_id"]), *ours)
