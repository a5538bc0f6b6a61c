"""Keyed tables that change together: batches as segments, one manifest a commit, levels of segments merged by size.

A commit writes a segment for each table it changes, then names all segments that hold in one manifest, which appears by a rename: until then, and
whatever fails before it, readers see what was there. A reader is pinned to a manifest and goes on seeing its state while others are committed.
Where so many segments of one size have come together they are merged to one, so a row is written again once a level. A segment has as
many parts by a hash of the owner column as its rows need, and a read for some owners meets their parts alone.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import delete, list_names, read_text, small, write_once

#: Segments of one level that become one, rows of a segment's part, manifests that readers may be pinned to.
FAN, PART_ROWS, KEEP = 8, 200_000, 3
#: Parts that each task may write a file of.
WRITTEN = 16
#: Parts that a read may name; one for more owners than that meets every part.
MOST_PARTS = 1000


@dataclass
class Keyed:
    """What a table holds: its columns, the key of a row and the column whose hash deals rows to parts (the key by default)."""

    schema: str
    key: str
    owner: str | None = None

    @property
    def dealt(self) -> str:
        return self.owner or self.key


@dataclass
class Segment:
    """A folder of a table's rows and tombstones, with the commits they are of."""

    name: str
    rows: int
    parts: int
    first: int
    last: int
    batch: str

    def level(self, fan: int) -> int:
        """Grows by one where the rows grow by the fan."""
        n, out = self.rows, 0
        while n >= fan:
            n, out = n // fan, out + 1
        return out


def merges(segments: list[Segment], fan: int) -> list[list[Segment]]:
    """Groups of segments to be merged: all of a level, where there are so many of it."""
    levels: dict[int, list[Segment]] = {}
    for s in segments:
        levels.setdefault(s.level(fan), []).append(s)
    return [group for _, group in sorted(levels.items()) if len(group) >= fan]


def parts_of(rows: int) -> int:
    """A power of two, so that few numbers of parts are met."""
    out = 1
    while out * PART_ROWS < rows:
        out *= 2
    return out


@dataclass
class View:
    """One state of the tables. Its rows stay readable until KEEP newer manifests are there."""

    tables: Tables
    version: int
    segments: dict[str, list[Segment]] = field(default_factory=dict)

    def read(self, table: str, owners: DataFrame | None = None) -> DataFrame:
        """Live rows; with `owners` (a table of the owner column), theirs alone.

        A row holds unless another segment has a newer row of its key. Keys and commits of all segments but the oldest are looked at for that, so
        the oldest one's rows are not shuffled where the rest is small.
        """
        kind, found = self.tables.kinds[table], self.segments.get(table, [])
        rows = self.tables.rows(table, found)
        if owners is not None and found:
            wanted = owners.select(kind.dealt).distinct()
            named = [F.concat(F.lit(f"{p}."), part(kind.dealt, p).cast("string")) for p in sorted({s.parts for s in found})]
            met = [r[0] for r in wanted.select(F.explode(F.array(*named)).alias("part")).distinct().limit(MOST_PARTS + 1).collect()]
            rows = rows.where(F.col("part").isin(met)) if len(met) <= MOST_PARTS else rows
            rows = rows.join(small(wanted), kind.dealt, "left_semi")
        return self.tables.newest(table, rows, found).where("NOT deleted").select(*self.tables.columns(table))


def part(owner: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(owner), F.lit(parts))


class Tables:
    """Tables under a folder on a file system with atomic renames; one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, path: str, kinds: dict[str, Keyed], fan: int = FAN, keep: int = KEEP):
        self.spark, self.path, self.kinds, self.fan, self.keep = spark, path.rstrip("/"), kinds, fan, keep

    def columns(self, table: str) -> list[str]:
        return self.spark.createDataFrame([], self.kinds[table].schema).columns

    def rows(self, table: str, segments: list[Segment]) -> DataFrame:
        """All rows of some segments, tombstones too, in one scan."""
        stored = f"{self.kinds[table].schema}, seq bigint, deleted boolean, segment string, part string"
        if not segments:
            return self.spark.createDataFrame([], stored)
        base = f"{self.path}/{table}"
        return self.spark.read.schema(stored).option("basePath", base).parquet(*[f"{base}/segment={s.name}" for s in segments])

    def newest(self, table: str, rows: DataFrame, segments: list[Segment]) -> DataFrame:
        if len(segments) < 2:
            return rows
        key, oldest = self.kinds[table].key, min(segments, key=lambda s: s.last)
        # what is older than all else, mostly the largest by far, can make no other row void
        rest = [s for s in segments if s is not oldest]
        rest = self.rows(table, rest if all(s.first > oldest.last for s in rest) else segments)
        last = rest.groupBy(key).agg(F.max("seq").alias("last_seq"))
        return rows.join(small(last), key, "left").where("last_seq IS NULL OR seq >= last_seq").drop("last_seq")

    def view(self, before: str | int | None = None) -> View:
        """The newest state; with `before`, the one before the last commit if that was of this batch (so that it can be run again)."""
        versions = [int(n.removesuffix(".json")) for n in list_names(self.spark, f"{self.path}/versions") if n.endswith(".json")]
        if not versions:
            return View(self, 0)
        version = max(versions)
        held = json.loads(read_text(self.spark, f"{self.path}/versions/{version:012d}.json"))
        segments = {t: [Segment(**s) for s in found] for t, found in held["segments"].items()}
        if before is not None and held["batch"] == str(before):
            segments = {t: [Segment(**s) for s in found] for t, found in held["before"].items()}
        return View(self, version, segments)

    def commit(self, batch: str | int, changes: dict[str, tuple[DataFrame, DataFrame | None]], merge: bool = False) -> int:
        """Puts rows (one a key) and deletes keys (with their owners, where those are columns of their own), in all tables named or in none; returns the version.

        A key in both is put. Changes are worked out twice, so a costly one should be stored. If the last commit was of this batch it is
        replaced; else the batch comes on top of what there is. With merge, each table becomes one segment.
        """
        prior = self.view(batch)
        version, now = prior.version + 1, {t: list(found) for t, found in prior.segments.items()}
        for table in self.kinds:
            found = now.get(table, [])
            groups = ([found] if len(found) > 1 else []) if merge else merges(found, self.fan)
            for group in groups:
                kept = [s for s in found if s not in group]
                # a tombstone is of use while an older row of its key may lie elsewhere
                oldest = all(s.first > max(g.last for g in group) for s in kept)
                live = self.newest(table, self.rows(table, group), group)
                live = live.where("NOT deleted") if oldest else live
                span = (min(g.first for g in group), max(g.last for g in group))
                found = sorted([*kept, self._write(table, live, sum(g.rows for g in group), span, "merged")], key=lambda s: s.first)
            now[table] = found
        before = {t: list(found) for t, found in now.items()}
        for table, (put, gone) in changes.items():
            kind = self.kinds[table]
            rows = put.select(*self.columns(table), F.lit(False).alias("deleted"))
            if gone is not None:
                names = list(dict.fromkeys([kind.key, kind.dealt]))
                gone = gone.select(*names).dropDuplicates([kind.key]).join(put.select(kind.key), kind.key, "left_anti")
                rows = rows.unionByName(gone.withColumn("deleted", F.lit(True)), allowMissingColumns=True)
            n = rows.count()
            if n:
                made = self._write(table, rows.withColumn("seq", F.lit(version).cast("bigint")), n, (version, version), str(batch))
                now.setdefault(table, []).append(made)
        told = {"batch": str(batch), "segments": _told(now), "before": _told(before)}
        write_once(self.spark, f"{self.path}/versions/{version:012d}.json", json.dumps(told))
        self.vacuum()
        return version

    def _write(self, table: str, rows: DataFrame, n: int, span: tuple[int, int], batch: str) -> Segment:
        parts, name = parts_of(n), f"{span[1]}-{uuid.uuid4().hex}"
        dealt = rows.drop("segment").withColumn("part", F.concat(F.lit(f"{parts}."), part(self.kinds[table].dealt, parts).cast("string")))
        # few parts are written by every task; rows are shuffled only where that would make too many files
        dealt = dealt.hint("rebalance", F.col("part")) if parts > WRITTEN else dealt
        dealt.write.partitionBy("part").parquet(f"{self.path}/{table}/segment={name}")
        if batch == "merged":
            n = self.rows(table, [Segment(name, n, parts, *span, batch)]).count()
        return Segment(name, n, parts, *span, batch)

    def reader(self, table: str) -> Reader:
        return Reader(self, table)

    def compact(self) -> int:
        """Every table as one segment; its state stays as it is."""
        return self.commit("compaction", {}, merge=True)

    def vacuum(self) -> None:
        """Deletes older manifests than the last `keep`, and segments that none of those names (such as those of failed commits)."""
        names = sorted(n for n in list_names(self.spark, f"{self.path}/versions"))
        whole = [n for n in names if n.endswith(".json")]
        kept = whole[-self.keep :]
        held = [json.loads(read_text(self.spark, f"{self.path}/versions/{n}")) for n in kept]
        for n in names:
            if n not in kept:
                delete(self.spark, f"{self.path}/versions/{n}")
        for table in self.kinds:
            used = {f"segment={s['name']}" for h in held for state in ("segments", "before") for s in h[state].get(table, [])}
            for name in set(list_names(self.spark, f"{self.path}/{table}")) - used:
                delete(self.spark, f"{self.path}/{table}/{name}")


def _told(segments: dict[str, list[Segment]]) -> dict[str, list[dict]]:
    return {t: [vars(s) for s in found] for t, found in segments.items()}


@dataclass
class Reader:
    """One of the tables, as it is when it is read."""

    tables: Tables
    table: str

    def read(self, before: str | int | None = None, owners: DataFrame | None = None) -> DataFrame:
        return self.tables.view(before).read(self.table, owners)


class KeyedLog:
    """One keyed table of its own."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, owner: str | None = None, fan: int = FAN):
        self.tables = Tables(spark, path, {"rows": Keyed(schema, key, owner)}, fan)

    def read(self, before: str | int | None = None, owners: DataFrame | None = None) -> DataFrame:
        return self.tables.view(before).read("rows", owners)

    def write(self, batch: str | int, put: DataFrame, gone: DataFrame | None = None) -> None:
        self.tables.commit(batch, {"rows": (put, gone)})

    def compact(self) -> None:
        self.tables.compact()
