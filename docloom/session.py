"""Sessions, tables and shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join of at most so many rows and bytes may be broadcast; beyond either the join is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 128 << 20
#: A table of fewer bytes a core may lie in fewer row groups than there are cores.
SPREAD_BYTES = 16 << 20
_scratch: list[list[str]] = []
#: The folder made where a local session names none.
_own: list[str] = []


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the launcher's settings hold."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where unset one made here, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="docloom-"))
        found = _own[0]
    return found if "://" in found or found.startswith("file:") else f"file://{os.path.abspath(found)}"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, wherever Spark can reach it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark can reach it; one that is not there is no error."""
    place, files = _place(spark, path)
    files.delete(place, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    place, files = _place(spark, path)
    return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    place, files = _place(spark, path)
    stream = files.open(place)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: written beside its place and renamed. One that is there already is an error."""
    place, files = _place(spark, path)
    beside, _ = _place(spark, f"{path}.{uuid.uuid4().hex}")
    stream = files.create(beside, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(beside), files.makeQualified(place), spark.sparkContext._gateway.new_array(rename, 0))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end; what is wanted of them must be written elsewhere by then."""
    paths: list[str] = []
    _scratch.append(paths)
    try:
        yield
    finally:
        _scratch.remove(paths)
        for path in paths:
            delete(spark, path)


def _bytes(name: str, kind: T.DataType) -> Column:
    """About how many bytes a value takes, by its own length where its type has none."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.BooleanType)):
        return F.greatest(F.size(c), F.lit(0)) * 8 + 32
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.length(F.to_json(F.struct(c))), F.lit(0)) * 2 + 32
    return F.lit(8)


def small(df: DataFrame, rows: int | None = None, size: int | None = None) -> DataFrame:
    """Hint a broadcast if, and only if, the table's rows and bytes, counted in one pass, are within the bounds."""
    total = sum((_bytes(f.name, f.dataType).cast("long") for f in df.schema.fields), F.lit(16))
    n, held = df.agg(F.count(F.lit(1)), F.sum(total)).first()
    within = n <= (BROADCAST_ROWS if rows is None else rows) and (held or 0) <= (BROADCAST_BYTES if size is None else size)
    return F.broadcast(df) if within else df


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores, for work that costs far more than moving them, if the table is so small by the optimizer's estimate
    that its few row groups could leave cores idle. A larger table is read as it lies, without a shuffle; a stream stays as it is."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if held < cores * SPREAD_BYTES else df


def fresh(name: str, taken: list[str]) -> str:
    """A column name that clashes with none of those taken."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name
