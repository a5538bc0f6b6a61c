"""Column functions on text. None of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the text rules, where \s is Unicode white space with the four ASCII separators.
PAGE_MARKER = r"^\s*(?:page\s+)?\d+\s*(?:of|/)\s*\d+\s*$"
SEPARATOR = r"^\s*[-_=*]{3,}\s*$"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z0-9(\"'])"
SPACE = r"(?U:[\s\x1c-\x1f])"
# The same white space as characters, but the plain space.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPARSE_BUCKETS = 65536
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def jvm(pattern: str, flags: str = "") -> str:
    """A pattern for the JVM, where \\s and \\d are Unicode's and only a line feed ends a line."""
    return f"(?d{flags})" + pattern.replace(r"\s", SPACE).replace(r"\d", r"\p{Nd}")


def strip(text: Column) -> Column:
    """No white space at either end."""
    return F.btrim(text, F.lit(" " + BLANKS))


def collapse(text: Column) -> Column:
    """Runs of white space to one space, none at the ends. A plain space that stands alone is no match, so most gaps cost no copy."""
    return F.trim(F.regexp_replace(text, f"(?! (?!{SPACE})){SPACE}+", " "))


def drop_boilerplate(text: Column) -> Column:
    """Lines that are page markers or separators go; line ends become LF."""
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    return F.array_join(F.filter(lines, lambda x: ~x.rlike(jvm(PAGE_MARKER, "iu")) & ~x.rlike(jvm(SEPARATOR))), "\n")


def lexical_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def normalize_text(text: Column) -> Column:
    """Boilerplate lines out, white space collapsed; an error if that changed the sequence of lexical tokens."""
    kept = drop_boilerplate(text)
    flat = collapse(kept)
    # the sequences as texts: the same terms in order, with one space between
    said = lambda t: F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "))
    fine = kept.isNull() | (said(kept) == said(flat))
    # flat stands outside of the condition, so that it is computed once for both
    return F.get(F.array(flat), F.when(fine, 0).otherwise(F.raise_error(F.lit("normalization changed the lexical tokens")).cast("int")))


def approx_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, or single other symbols."""
    return F.size(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"), 1)).cast("bigint")


def word_count(text: Column) -> Column:
    flat = collapse(text)
    return (F.size(F.split(flat, " ")) - F.when(flat == "", 1).otherwise(0)).cast("bigint")


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(strip(text), jvm(SENTENCE_GAP)), strip)
    return F.filter(parts, lambda s: s != "")


def term_counts(text: Column, buckets: int = SPARSE_BUCKETS) -> Column:
    """(bucket, tf) of a text's hashed terms in order of the bucket, counted inside the row: sorted, then cut where they change."""
    hashed = F.sort_array(F.transform(lexical_tokens(text), lambda t: term_bucket(t, buckets)))

    def runs(h: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i == 0) | (F.get(h, i) != F.get(h, i - 1)))
        # transform over an array of one binds a value, which a lambda would else compute again for each element
        each = lambda at: F.transform(at, lambda p, j: F.struct(F.get(h, p).alias("bucket"), (F.coalesce(F.get(at, j + 1), F.size(h)) - p).cast("bigint").alias("tf")))
        return F.transform(F.array(starts), each)[0]

    none = F.array().cast("array<struct<bucket:int,tf:bigint>>")
    return F.transform(F.array(hashed), lambda h: F.when(F.size(h) > 0, runs(h)).otherwise(none))[0]


def term_bucket(term: Column, buckets: int = SPARSE_BUCKETS) -> Column:
    return (F.crc32(F.encode(term, "UTF-8")) % buckets).cast("int")


def uuid5(name: Column) -> Column:
    """UUIDv5 of a name in the URL namespace."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8"))), 1, 32)
    digit = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    h = F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), F.lower(F.hex(digit.cast("bigint"))), F.substring(h, 18, 15))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def backoff_ceiling(retries: Column, base: float = 1.0, cap: float = 60.0) -> Column:
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), retries))


def call_cost(tokens_in: Column, tokens_out: Column, cached: Column, rate_in: Column, rate_out: Column) -> Column:
    """Cost of a call; null unless both rates are known and no cached tokens took part."""
    known = rate_in.isNotNull() & rate_out.isNotNull() & (F.coalesce(cached, F.lit(0)) == 0)
    return F.when(known, (F.coalesce(tokens_in, F.lit(0)) * rate_in + F.coalesce(tokens_out, F.lit(0)) * rate_out) / 1e6)


def strict_sum(value: Column) -> Column:
    """Null if any value is."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def usage(reply: Column, rate_in: Column, rate_out: Column) -> Column:
    """Token counts of a model's reply (nulls count 0), their total and the cost; a null reply used nothing and has no cost."""
    names = ["input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"]
    counts = {n: F.coalesce(reply[n], F.lit(0)).cast("bigint") for n in names}
    a, b, c, d = counts.values()
    cost = F.when(reply.isNotNull(), call_cost(a, b, c + d, rate_in, rate_out))
    return F.struct(*[v.alias(k) for k, v in counts.items()], (a + b + c + d).alias("total_tokens"), cost.alias("cost_usd"))


def judge_scores(said: Column) -> Column:
    """The first JSON object of a judge's text (fences and prose around it are passed over, objects in it are not): three numbers
    from 0 to 1, else an error."""
    names = ["faithfulness", "answer_relevance", "context_precision"]
    read = F.from_json(F.regexp_extract(said, r"(?s)\{.*", 0), ", ".join(f"{n} double" for n in names))
    fine = [F.coalesce(read[n].between(0.0, 1.0), F.lit(False)) for n in names]
    return F.when(fine[0] & fine[1] & fine[2], read).otherwise(F.raise_error(F.concat(F.lit("not a judge's scores: "), F.coalesce(said, F.lit("null")))))
