"""Queries of this package for __spark_entry__.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.chat import chat_digests
from docloom.llm.decontaminate import find_leaks
from docloom.llm.extract import extract_pages
from docloom.llm.infill import infill_digests
from docloom.llm.jaccard import similar_documents
from docloom.llm.licenses import scan_licenses
from docloom.llm.media import document_media
from docloom.llm.mixing import mix
from docloom.llm.packing import pack_documents
from docloom.llm.pitman_yor import score_documents
from docloom.llm.quality import score_quality
from docloom.llm.resample import resample
from docloom.llm.sharding import shard_documents
from docloom.session import table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), size=4, percent=85)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "kept")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    turns = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    return chat_digests(rows.unionByName(turns))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), texts=False)
    return out.select("doc_id", "source", "lang", "evidence", "host_site", "site", "quality", "good")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 40)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill_digests(table(spark, sf_dir, "documents"))


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of operator 2 that SQL can tell: tokens and the base score."""
    out = op2_lm_scoring(spark, sf_dir)
    return out.select("doc_id", "n_tokens", "n_known", "train_tokens", "held_out", F.round("base_score", 6).alias("base_score"))


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of operator 6 that SQL can tell: words and base places."""
    return op6_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of operator 9 that SQL can tell: the payload as it was read back."""
    return op9_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def shard_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operator 10 gives whatever the draws: sizes, and slots gapless by doc_id within a shard, summed up by shard."""
    out = op10_sharding(spark, sf_dir)
    sums = out.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), (F.max("slot") + 1).alias("slots"), F.count_distinct("slot").alias("distinct_slots"), F.sum("size").alias("bytes"))
    return sums.agg(F.sum("n").alias("n"), F.sum("slots").alias("slots"), F.sum("distinct_slots").alias("distinct_slots"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("shards"))


QUERIES = {f.__name__: f for f in (lm_base, license_places, media_payloads, shard_law, op1_ngram_jaccard, op2_lm_scoring, op3_decontamination, op4_html_extraction, op5_mixing, op6_license_scan, op7_chat_formatting, op8_quality, op9_media_columns, op10_sharding, op11_resampling, op12_packing, op13_infill)}

OP7_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, 12 + length(url_encode(role)) + 1 + 11 + length(text) + (length(text) - length(replace(text, '\', '')))
    + len(regexp_extract_all(text, '<\||\|>|</?s>|\[/?INST\]|<</?SYS>>')) AS piece_chars
  FROM said)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(piece_chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
WORDS_SQL = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
OP3_SQL = f"""
WITH item_words AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
items AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS width,
    list_sort(list_distinct(list_transform(range(0, len(w) - least(len(w), 5) + 1), lambda i: array_to_string(w[i + 1 : i + least(len(w), 5)], ' ')))) AS h
  FROM item_words WHERE len(w) > 0),
numbered AS (SELECT row_number() OVER () AS item, * FROM items),
item_rows AS (SELECT item, item_id, width, len(h) AS m, unnest(h) AS g FROM numbered),
doc_words AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents WHERE doc_id IS NOT NULL),
doc_rows AS (
  SELECT DISTINCT doc_id, width, g FROM (
    SELECT doc_id, width, unnest(list_transform(range(0, len(w) - width + 1), lambda i: array_to_string(w[i + 1 : i + width], ' '))) AS g
    FROM doc_words, (SELECT DISTINCT width FROM items) WHERE len(w) >= width)),
pairs AS (SELECT doc_id, item_id, item, m, count(*) AS hits FROM doc_rows JOIN item_rows USING (width, g) GROUP BY ALL)
SELECT doc_id, item_id, arg_max(hits, hits / m) AS hits, arg_max(m, hits / m)::INTEGER AS m, max(hits / m) AS containment
FROM pairs WHERE hits * 1000 >= m * 800 GROUP BY doc_id, item_id
"""


def _raking_sql() -> str:
    steps, last = [], "cell0"
    for i in range(8):
        for d in ("source", "lang", "topic"):
            name = f"r{i}_{d}"
            total = f"sum(weight) OVER (PARTITION BY {d})"
            steps.append(f"{name} AS (SELECT source, lang, topic, tokens, source_target, lang_target, topic_target, CASE WHEN {total} > 0 THEN weight * {d}_target / {total} ELSE 0 END AS weight FROM {last})")
            last = name
    shares = ", ".join(
        f"{d}_share AS (SELECT {d}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens)::DOUBLE / (SELECT sum(tokens) FROM cells), {p}) ELSE 0 END AS s FROM cells GROUP BY {d})"
        for d, p in (("source", 0.7), ("lang", 0.7), ("topic", 1.0))
    )
    targets = ", ".join(f"(SELECT s FROM {d}_share x WHERE x.{d} IS NOT DISTINCT FROM cells.{d}) / (SELECT sum(s) FROM {d}_share) AS {d}_target" for d in ("source", "lang", "topic"))
    squeezed = r"trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'))"
    return rf"""
WITH body AS (SELECT doc_id, source, lang, coalesce(text, '') AS body, length(coalesce(text, '')) AS n, {squeezed} AS flat FROM documents),
marked AS (SELECT doc_id, source, lang,
  CASE WHEN n = 0 THEN 'empty' WHEN n - length(replace(body, ' | ', '')) >= n * 0.06 THEN 'table'
    WHEN n - length(replace(body, '!! ', '')) >= n * 0.1 THEN 'shouting' WHEN n - length(translate(body, '$%&*#', '')) >= n * 0.1 THEN 'symbols'
    WHEN n < 600 THEN 'note' WHEN n < 12000 THEN 'article' ELSE 'book' END AS topic,
  CASE WHEN flat = '' THEN 0 ELSE length(flat) - length(replace(flat, ' ', '')) + 1 END::BIGINT AS tokens FROM body),
cells AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM marked GROUP BY ALL),
{shares},
cell0 AS (SELECT *, tokens::DOUBLE AS weight, {targets} FROM cells),
{", ".join(steps)},
looked AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN round(weight * (SELECT sum(tokens) FROM cells) / tokens, 9) ELSE 0 END AS cell_weight FROM {last})
SELECT doc_id, m.source, m.lang, m.topic, m.tokens, CASE WHEN m.tokens > 0 THEN cell_weight ELSE 0 END AS weight,
  round(least(1.0, CASE WHEN m.tokens > 0 THEN cell_weight ELSE 0 END * 0.5), 9) AS probability,
  ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / 281474976710656.0 < round(least(1.0, CASE WHEN m.tokens > 0 THEN cell_weight ELSE 0 END * 0.5), 9) AS kept
FROM marked m JOIN looked l ON m.source IS NOT DISTINCT FROM l.source AND m.lang IS NOT DISTINCT FROM l.lang AND m.topic = l.topic
"""


OP1_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS g FROM w),
rows AS (SELECT doc_id, unnest(g) AS g FROM sets),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM rows x JOIN rows y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * same >= 85 * (len(x.g) + len(y.g) - same)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS seen FROM sets UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.seen)
SELECT doc_id, len(g)::BIGINT AS n_shingles, (SELECT min(seen) FROM reach WHERE reach.doc_id = sets.doc_id) AS component_id FROM sets
"""
#: crc32 of doc_id as text, over a table of the polynomial's remainders.
_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord((doc_id::VARCHAR)[i])::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295)"


def _remainders() -> str:
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(str(x))
    return "[" + ", ".join(out) + "]::BIGINT[]"


LM_SQL = f"""
WITH crc AS (SELECT {_remainders()} AS t),
w AS (SELECT doc_id, {_CRC32} % 7 = 2 AS held_out, list_append({WORDS_SQL}, '') AS w FROM documents, crc),
said AS (SELECT doc_id, held_out, unnest(w) AS word FROM w),
counted AS (SELECT word, count(*) AS c FROM said WHERE NOT held_out GROUP BY word),
total AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM counted)
SELECT doc_id, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, any_value(held_out) AS held_out,
  round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1)::DOUBLE)), 6) AS base_score
FROM said LEFT JOIN counted USING (word), total GROUP BY doc_id
"""
_BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(0, len(w)), lambda i: array_to_string(w[i + 1 : i + {len(phrase.split())}], ' ') = '{phrase}')) AS place FROM w" for phrase, label in _BASE.items()
)
LICENSE_SQL = rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
f AS ({_FOUND})
SELECT doc_id, len(any_value(w))::BIGINT AS n_words, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM w LEFT JOIN f USING (doc_id) GROUP BY doc_id
"""
MEDIA_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS body FROM documents),
s AS (SELECT doc_id, body, octet_length(body)::BIGINT AS n, CASE WHEN octet_length(body) = 0 THEN 576 ELSE (576 - octet_length(body) % 576) % 576 END AS more FROM d)
SELECT doc_id, n AS n_bytes, n + more AS payload_bytes, sha256(body || unhex(repeat('FF', more::INTEGER))) AS payload_sha256 FROM s
"""
SHARD_SQL = "SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS slots, count(*)::BIGINT AS distinct_slots, sum(octet_length(encode(coalesce(text, ''))) + 16)::BIGINT AS bytes, 40::BIGINT AS shards FROM documents"
#: crc32 of the bytes of `term`, by the same table.
_TERM_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(b) + 1), lambda i: ('0x' || h[2 * i - 1 : 2 * i])::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295)"
RESAMPLE_SQL = rf"""
WITH crc AS (SELECT {_remainders()} AS t),
w AS (SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM (SELECT 's' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark)),
f AS (SELECT kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS term FROM w),
coded AS (SELECT term, {_TERM_CRC} % 10000 AS bucket FROM (SELECT term, encode(term) AS b, hex(encode(term)) AS h FROM (SELECT DISTINCT term FROM f)), crc),
hits AS (SELECT kind, id, bucket, count(*) AS n FROM f JOIN coded USING (term) GROUP BY ALL),
counts AS (SELECT range AS bucket, coalesce(sum(n) FILTER (kind = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 't'), 0)::DOUBLE AS t FROM range(10000) LEFT JOIN hits ON bucket = range GROUP BY range),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + 10000) / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000))))::BIGINT AS gain FROM counts),
weighed AS (SELECT id, sum(n) AS n_features, sum(n * gain) AS weight FROM hits JOIN gains USING (bucket) WHERE kind = 's' GROUP BY id),
scored AS (SELECT id AS doc_id, len(w) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM w LEFT JOIN weighed USING (id) WHERE kind = 's'),
placed AS (SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) END AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM scored WHERE words >= 20) * 5 // 100 THEN place END AS rank FROM placed
"""
INFILL_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
k AS (SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(u[1 : low], '') AS prefix, array_to_string(u[low + 1 : high], '') AS middle, array_to_string(u[high + 1 :], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

ORACLE_SQL = {
    "op1_ngram_jaccard": OP1_SQL, "op3_decontamination": OP3_SQL, "op5_mixing": _raking_sql(), "op7_chat_formatting": OP7_SQL,
    "lm_base": LM_SQL, "license_places": LICENSE_SQL, "media_payloads": MEDIA_SQL, "shard_law": SHARD_SQL,
    "op11_resampling": RESAMPLE_SQL, "op13_infill": INFILL_SQL,
}
