"""Keyed tables: what holds after any batches, one commit over all tables, pinned readers, merges and the bounds of what they rewrite."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.session import list_names
from docloom.sources import tables
from docloom.sources.tables import Keyed, KeyedLog, Segment, Tables, merges, parts_of

SCHEMA = "k string, o string, v bigint"


def rows(spark, *found):
    return spark.createDataFrame(list(found), SCHEMA)


def held(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("part_rows", [200_000, 2])
def test_any_batches_with_merges(spark, tmp_path, monkeypatch, part_rows):
    """Random puts and deletes, some batches run twice: reads of all and of some owners equal a dictionary."""
    monkeypatch.setattr(tables, "PART_ROWS", part_rows)
    log, want, rng = KeyedLog(spark, str(tmp_path / "log"), SCHEMA, "k", "o", fan=2), {}, random.Random(part_rows)
    for n in range(9):
        put = {k: (k, f"o{int(k[1:]) % 5}", n) for k in {f"k{rng.randrange(14)}" for _ in range(rng.choice([1, 3, 9]))}}
        gone = {f"k{rng.randrange(14)}" for _ in range(3)}
        if n % 3 == 1:
            log.write(n, rows(spark, ("k0", "o0", -1)), rows(spark, *[(k, f"o{int(k[1:]) % 5}", 0) for k in put]))  # fails later on, and is run again
        log.write(n, rows(spark, *put.values()), rows(spark, *[(k, f"o{int(k[1:]) % 5}", 0) for k in gone]))
        want = {k: r for k, r in want.items() if k not in gone} | put
        assert held(log.read()) == set(want.values())
    some = spark.createDataFrame([("o1",), ("o1",), ("o3",), ("none",)], "o string")
    assert held(log.read(owners=some)) == {r for r in want.values() if r[1] in ("o1", "o3")}
    view = log.tables.view()
    assert len(view.segments["rows"]) < 6
    log.compact()
    assert held(log.read()) == set(want.values()) and [s.rows for s in log.tables.view().segments["rows"]] == [len(want)]
    assert log.tables.view().segments["rows"][0].parts >= parts_of(len(want))


def test_rewritten_rows_of_200_batches():
    """By the rule of merges alone: rows are written again at most once a level, and few segments are there at any time."""
    for sizes in ([100] * 200, [1] * 200, [random.Random(n).choice([0, 1, 10, 5000]) for n in range(200)]):
        found, written, fan = [], 0, 4
        for n, size in enumerate(sizes):
            for group in merges(found, fan):
                total = sum(s.rows for s in group)
                written += total
                found = [s for s in found if s not in group] + [Segment("m", total, 1, group[0].first, group[-1].last, "merged")]
            found.append(Segment(str(n), size, 1, n, n, str(n)))
            assert len(found) <= (fan + 1) * (found and max(s.level(fan) for s in found) + 1)
        levels = Segment("", sum(sizes), 1, 0, 0, "").level(fan) + 1
        assert written <= levels * sum(sizes)


def test_two_tables_in_one_commit(spark, tmp_path, monkeypatch):
    """Whatever write fails, both tables are as before; a later commit takes what was left behind away."""
    both = Tables(spark, str(tmp_path / "t"), {"a": Keyed(SCHEMA, "k"), "b": Keyed(SCHEMA, "k")}, fan=2)
    state = lambda: (held(both.reader("a").read()), held(both.reader("b").read()))
    for n in range(4):
        both.commit(n, {"a": (rows(spark, (f"a{n}", "", n)), None), "b": (rows(spark, (f"b{n}", "", n)), None)})
    before = state()
    change = lambda: both.commit("x", {"a": (rows(spark, ("a9", "", 9)), rows(spark, ("a0", "", 0))), "b": (rows(spark, ("b9", "", 9)), None)})
    write, once = Tables._write, tables.write_once
    calls = []
    for fail_at in range(9):
        calls.clear()

        def step(inner, *args):
            calls.append(1)
            if len(calls) == fail_at + 1:
                raise OSError("lost")
            return inner(*args)

        monkeypatch.setattr(Tables, "_write", lambda self, *a: step(write, self, *a))
        monkeypatch.setattr(tables, "write_once", lambda *a: step(once, *a))
        try:
            change()
            break
        except OSError:
            assert state() == before
    assert fail_at == 5  # two merges, two segments and the manifest could fail
    after = ({("a1", "", 1), ("a2", "", 2), ("a3", "", 3), ("a9", "", 9)}, before[1] | {("b9", "", 9)})
    assert state() == after
    used = {s.name for v in [both.view()] for found in v.segments.values() for s in found}
    monkeypatch.undo()
    both.compact(), both.compact(), both.compact()
    assert state() == after and len(list_names(spark, f"{tmp_path}/t/a")) <= 3 and used


def test_pinned_readers(spark, tmp_path):
    """A reader goes on seeing its state through a commit and a compaction; its files go when it is too old."""
    log = KeyedLog(spark, str(tmp_path / "log"), SCHEMA, "k")
    log.write(0, rows(spark, ("a", "", 1), ("b", "", 1)))
    log.write(1, rows(spark, ("a", "", 2)))
    view = log.tables.view()
    log.write(2, rows(spark, ("b", "", 3)), rows(spark, ("a", "", 0)))
    log.compact()
    assert held(view.read("rows")) == {("a", "", 2), ("b", "", 1)} and held(log.read()) == {("b", "", 3)}
    log.write(3, rows(spark, ("c", "", 1))), log.compact()
    assert len(list_names(spark, f"{tmp_path}/log/versions")) == 3
    with pytest.raises(Exception, match="(?i)not.*exist"):
        view.read("rows").collect()


def test_a_read_for_owners_meets_their_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "PART_ROWS", 10)
    log = KeyedLog(spark, str(tmp_path / "log"), SCHEMA, "k", "o")
    log.write(0, spark.range(160).select(F.concat(F.lit("k"), "id").alias("k"), F.concat(F.lit("o"), "id").alias("o"), F.col("id").alias("v")))
    assert log.tables.view().segments["rows"][0].parts == 16
    one = log.read(owners=spark.createDataFrame([("o7",)], "o string"))
    assert held(one) == {("k7", "o7", 7)}
    assert re.search(r"PartitionFilters: \[.*\(part#\d+ = 16\.\d+\)", one._jdf.queryExecution().toString())
