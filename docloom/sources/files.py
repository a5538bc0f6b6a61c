"""Files in: batch and stream scans, validation and routing, question sets."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from docloom.functions.text import collapse, uuid5
from docloom.sources import pdf

# Extensions and their types.
MIME = {".pdf": "application/pdf", ".md": "text/markdown", ".markdown": "text/markdown", ".html": "text/html", ".htm": "text/html"}
BINARY = "path string, modificationTime timestamp, length bigint, content binary"
QA = "schema_version int, dataset_version string, cases array<struct<id:string,question:string,reference_answer:string,expected_source_uri_contains:string>>"


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def watch_files(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """A stream of files moved into a folder (moves are atomic, so no file is met half written)."""
    return spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", per_trigger).load(folder)


def validate(files: DataFrame, path: str = "path", content: str = "content", pdf_pages: Callable[[bytes], list[str | None]] | None = pdf.pages) -> DataFrame:
    """Adds doc_id, source_uri (an absolute path, or a URI of another file system), mime_type, ok and reason: the type goes by extension, the content is looked at for sanity.

    A PDF is valid if the parser reads its pages and there are some; the reason is the parser's. Other rows give the parser nothing to read.
    """

    def unread(contents: pd.Series) -> pd.Series:
        out = []
        for c in contents:
            try:
                out.append(None if c is None or pdf_pages(c) else "PDF has no pages")
            except Exception as error:
                out.append(str(error).split("\n")[0] or "not a readable PDF")
        return pd.Series(out, dtype=object)

    ending = F.lower(F.regexp_extract(F.col(path), r"[^/](\.[^./]+)$", 1))
    mime = F.element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), ending)
    utf8 = F.is_valid_utf8(F.col(content).cast("string"))
    text = F.col(content).cast("string")
    reason = (
        F.when(mime.isNull(), F.concat(F.lit("unsupported extension '"), ending, F.lit("'")))
        .when((mime != "application/pdf") & ~utf8, "content is not UTF-8")
        .when((mime == "text/markdown") & (collapse(text) == ""), "document is empty")
        .when((mime == "text/html") & ~text.rlike("<[A-Za-z]"), "no HTML tags found")
    )
    if pdf_pages:
        reason = F.coalesce(reason, pandas_udf(unread, "string")(F.when(mime == "application/pdf", F.coalesce(content, F.lit(b"")))))
    place = F.regexp_replace(F.col(path), "^file:(//)?(?=/)", "")
    return files.withColumns({"doc_id": uuid5(place), "source_uri": place, "mime_type": mime, "reason": reason}).withColumn("ok", F.col("reason").isNull())


def route(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid documents, and the rest with their reasons."""
    return checked.where("ok"), checked.where("NOT ok")


def read_texts(checked: DataFrame, pdf_pages: Callable[[bytes], list[str | None]] | None = pdf.pages, pdf_title: Callable[[bytes], str | None] | None = pdf.title) -> DataFrame:
    """doc_id, source_uri, mime_type, size_bytes, timestamp (epoch seconds), text, pdf_title and reason of validated files.

    Text is strict UTF-8. PDF pages come from the given parser, joined by blank lines, a page without text as an empty
    one. A PDF that the parser fails on has a null text and the reason; the others of its batch are not touched by that.
    """

    def parse(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            try:
                rows.append(("\n\n".join(p or "" for p in pdf_pages(c)), pdf_title(c) if pdf_title else None, None))
            except Exception as error:
                rows.append((None, None, f"PDF could not be read: {error}".split("\n")[0]))
        return pd.DataFrame(rows, columns=["text", "title", "reason"], dtype=object)

    named = checked.select("doc_id", "source_uri", "mime_type", F.col("length").alias("size_bytes"), F.col("modificationTime").cast("double").alias("timestamp"), "content")
    is_pdf = F.coalesce(F.col("mime_type") == "application/pdf", F.lit(False))
    none = F.lit(None).cast("string")
    text = named.where(~is_pdf).withColumns({"text": F.validate_utf8(F.col("content").cast("string")), "pdf_title": none, "reason": none})
    if not pdf_pages:
        read = named.where(is_pdf).withColumns({"text": none, "pdf_title": none, "reason": F.lit("no PDF parser was given")})
    else:  # a UDF inside a condition would run on every row, so PDFs go their own way
        told = pandas_udf(parse, "text string, title string, reason string")
        read = named.where(is_pdf).withColumn("p", told("content")).withColumns({"text": F.col("p.text"), "pdf_title": F.col("p.title"), "reason": F.col("p.reason")}).drop("p")
    return text.unionByName(read).drop("content")


def settled(files: DataFrame, seconds: float = 1.0) -> DataFrame:
    """Files that were not written to for so long: the rest may still be on their way, and a later listing has them."""
    return files.where(F.col("modificationTime").cast("double") <= F.unix_micros(F.current_timestamp()) / 1e6 - seconds)


def kafka_source(spark: SparkSession, servers: str, topic: str, schema: str) -> DataFrame:
    """A topic of JSON records from its start, as a stream of rows; needs Spark's Kafka package on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return from_records(raw, schema)


def from_records(raw: DataFrame, schema: str) -> DataFrame:
    """Rows of (key, value) records. A record that is no JSON of the schema has null columns and its text in `bad`."""
    text = F.col("value").cast("string")
    read = raw.select(text.alias("bad"), F.from_json(text, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    wrong = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return read.select("r.*", F.when(wrong, F.col("bad")).alias("bad")).drop("_bad")


def to_records(df: DataFrame, key: str) -> DataFrame:
    """(key, value) records for a Kafka sink: the key column and the whole row as JSON, nulls included."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def load_question_lines(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a question set of any size, a JSON object a line, with the version of their set; missing keys and repeated ids raise when they are read."""
    names = ["dataset_version", "id", "question", "reference_answer", "expected_source_uri_contains"]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).json(path)
    missing = F.lit(False)
    for n in names:
        missing = missing | F.col(n).isNull()
    counted = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *[F.first(n).alias(n) for n in names if n != "id"])
    wrong = F.when(missing, "a case needs all keys").when(F.col("n") > 1, "a case needs an id of its own")
    return counted.withColumn("id", F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.lit(": "), F.coalesce("id", F.lit("null")))).cast("string")).otherwise(F.col("id"))).select(*names)


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a version 1 question set; other versions, empty sets, missing keys and repeated ids raise."""
    sets = spark.read.schema(QA).json(path, multiLine=True)
    row = sets.select("schema_version", F.size("cases").alias("n")).first()
    if row is None or row["schema_version"] != 1 or row["n"] < 1:
        raise ValueError("a version 1 question set with cases is needed")
    cases = sets.select("dataset_version", F.inline("cases"))
    if cases.where(" OR ".join(f"{c} IS NULL" for c in cases.columns[1:])).count() or cases.count() != cases.select("id").distinct().count():
        raise ValueError("cases need all keys and ids of their own")
    return cases
