"""Broadcast bounds, scratch tables and the shared folder."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from docloom import session


def hinted(df):
    return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()


def test_small_counts_rows_and_bytes(spark):
    df = spark.range(1000).select("id", F.repeat(F.lit("x"), 500).alias("text"), F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    assert hinted(session.small(df)) and hinted(session.small(df.limit(0)))
    assert not hinted(session.small(df, rows=999)) and not hinted(session.small(df, size=500_000))
    nested = df.select(F.array(F.struct("text")).alias("a"))
    assert not hinted(session.small(nested, size=500_000))


def test_only_small_tables_are_spread(spark, monkeypatch, tmp_path):
    shuffled = lambda df: "Repartition" in df._jdf.queryExecution().analyzed().toString()
    spark.range(50).coalesce(1).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    assert shuffled(session.spread(rows)) and session.spread(rows).count() == 50 and session.spread(rows.limit(0)).count() == 0
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/t")
    assert session.spread(stream) is stream
    monkeypatch.setattr(session, "SPREAD_BYTES", 0)
    assert not shuffled(session.spread(rows))


def test_scratch_tables_go(spark):
    with session.scratch(spark):
        path = session.store(spark.range(3), "gone").inputFiles()[0].removeprefix("file://").removeprefix("file:")
        kept = session.new_path(spark, "x")
        assert os.path.exists(path)
    assert not os.path.exists(path) and not os.path.exists(kept)
    assert session.store(spark.range(3), "stays").count() == 3


def test_a_cluster_needs_a_shared_folder():
    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError):
        session.shared_dir(far)


def test_a_session_without_the_setting_has_a_folder_of_its_own(tmp_path):
    """Spark's own defaults name no folder here, and a running session cannot be given one."""
    code = "from docloom.session import local_session, store, shared_dir; s = local_session(2, 2); assert s.conf.get('spark.checkpoint.dir', None) is None; print(store(s.range(5), 'x').count(), shared_dir(s) == shared_dir(s))"
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=240)
    assert done.stdout.split() == ["5", "True"], done.stderr[-2000:]
