"""Operator 13: fill-in-middle by escaped marker injection.

A delimiter is escaped in the text; one regexp_replace appends it after each unit (white space and the word behind it); the delimiters
counted are the units; substring_index takes the parts before two ranked delimiters; parts lose their delimiters, are unescaped
and put together in prefix-suffix-middle or suffix-prefix-middle order. Column expressions only, one pass, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import fresh

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Neither is white space, so a unit of the escaped text is the escape of one unit of the text.
DELIMITER, ESCAPE = "\x1e", "\x10"


def _escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(DELIMITER), F.lit(ESCAPE + "d"))


def _plain(marked: Column) -> Column:
    """The text of marked units: delimiters go, then escapes (each ESCAPE is followed by its letter, so their order is free)."""
    bare = F.replace(marked, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "d"), F.lit(DELIMITER)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def _before(text: Column, mark: Column | str, n: Column | int) -> Column:
    part = lambda c: F.lit(c) if not isinstance(c, Column) else c
    return F.call_function("substring_index", text, part(mark), part(n))


def _after(text: Column, head: Column, skip: int = 0) -> Column:
    """What follows the head (a start of the text) and `skip` characters."""
    return F.substr(text, F.char_length(head) + (skip + 1))


def fill_in_middle(docs: DataFrame, percent: int = 50, spm_percent: int = 80, seed: int = 42, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"), key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs, then n (units), form (plain, psm or spm), prefix, middle, suffix and output; clashing names get an underscore.

    Four 32-bit numbers from sha256 of seed and key decide alone, so a row's form and cuts are the same wherever and however often it
    is worked on; repeated rows get equal results, ties do not arise. A null text counts as empty; an empty text and one that holds a mark stay plain, with
    null parts. A null key is the word null. A text may be of any length, one task holds it and a few copies. An empty table gives an empty table.
    """
    named = {c: fresh(c, docs.columns) for c in ("n", "form", "prefix", "middle", "suffix", "output", "_h", "_body", "_marked", "_low", "_high")}
    col = {c: F.col(n) for c, n in named.items()}
    number = lambda i: F.conv(F.substring(col["_h"], 8 * i + 1, 8), 16, 10).cast("bigint")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumns({named["_h"]: F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))), 256), named["_body"]: body})
    rows = rows.withColumn(named["_marked"], F.regexp_replace(_escape(col["_body"]), F.lit(UNIT), F.lit("$0" + DELIMITER)))
    units = (F.octet_length(col["_marked"]) - F.octet_length(F.replace(col["_marked"], F.lit(DELIMITER), F.lit("")))).cast("bigint")
    marked = col["_body"] == ""
    for m in marks:
        marked = marked | F.contains(col["_body"], F.lit(m))
    form = F.when(marked | (number(2) % 100 >= percent), "plain").when(number(3) % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.withColumn(named["n"], units).withColumn(named["form"], form)
    cuts = [number(i) % (col["n"] + 1) for i in (0, 1)]
    rows = rows.withColumns({named["_low"]: F.least(*cuts).cast("int"), named["_high"]: F.greatest(*cuts).cast("int")})
    cut = col["form"] != "plain"
    rows = rows.withColumns({named["prefix"]: F.when(cut, _plain(_before(col["_marked"], DELIMITER, col["_low"]))), named["middle"]: F.when(cut, _plain(_before(col["_marked"], DELIMITER, col["_high"])))})
    # what lies before the higher cut is prefix and middle; behind it, in the text, lies the suffix
    rows = rows.withColumns({named["suffix"]: _after(col["_body"], col["middle"]), named["middle"]: _after(col["middle"], col["prefix"])})
    p, s, m = (F.lit(x) for x in marks)
    whole = F.when(~cut, col["_body"]).when(col["form"] == "psm", F.concat(p, col["prefix"], s, col["suffix"], m, col["middle"])).otherwise(F.concat(s, col["suffix"], p, col["prefix"], m, col["middle"]))
    rows = rows.withColumn(named["output"], whole)
    return rows.select(*docs.columns, *[col[c] for c in ("n", "form", "prefix", "middle", "suffix", "output")])


def restore(output: Column, form: Column, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text from output and form alone. No part holds a mark, and one of these marks cannot begin inside a part and end in another mark.

    Null where either is null."""
    p, s, m = marks
    psm = form == "psm"
    inner = F.substr(output, F.when(psm, F.lit(len(p) + 1)).otherwise(F.lit(len(s) + 1)))
    second = F.when(psm, F.lit(s)).otherwise(F.lit(p))
    first = _before(inner, second, 1)
    rest = F.substr(inner, F.char_length(first) + F.char_length(second) + 1)
    then = _before(rest, m, 1)
    middle = _after(rest, then, len(m))
    return F.when(form == "plain", output).when(psm, F.concat(first, middle, then)).otherwise(F.concat(then, middle, first))


def infill_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256: fill_in_middle's rows and what is read back from them, as digests."""
    rows = fill_in_middle(docs.select("doc_id", "text"))
    back = rows.withColumn("restored", restore(F.col("output"), F.col("form")))
    long = lambda c: F.char_length(c).cast("bigint")
    return back.select("doc_id", "n", "form", long("prefix").alias("prefix_chars"), long("middle").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
