"""Operator 7: chat formatting of typed content parts.

A message's content is an ordered list of parts: text, image, audio or document. A visitor flattens the parts to one
string, with a placeholder for every attachment, and records for each attachment its kind, reference, place among the
conversation's attachments and the number of tokens that its placeholder expands to. Turns are framed as
``<|im_start|>role\\n...<|im_end|>\\n``; control strings inside texts are escaped reversibly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

PART = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("pages", T.LongType()),
    ]
)
PARTS = T.ArrayType(PART)
START, END = "<|im_start|>", "<|im_end|>\n"
#: What a text may not hold unescaped: our own marks and those of other common templates.
CONTROL = r"<\||\|>|</?s>|\[/?INST\]|<</?SYS>>"
#: Patch edge in pixels of an image, audio frames a second, tokens a page of a document.
IMAGE_PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512


def escape(text: Column) -> Column:
    """Double each backslash, then put one behind the first character of each control string."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, f"(?=(?:{CONTROL}))(.)", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def text_part(text: Column) -> Column:
    """The parts of a plain text message."""
    fields = [F.lit(None).cast(f.dataType).alias(f.name) for f in PART.fields]
    fields[0], fields[1] = F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text")
    return F.array(F.struct(*fields))


def placeholder_tokens(part: Column) -> Column:
    """Tokens an attachment expands to: image patches, audio frames, document pages; at least 1, and 0 for text."""
    patches = F.ceil(part["width"] / IMAGE_PATCH) * F.ceil(part["height"] / IMAGE_PATCH)
    least = lambda n: F.greatest(F.coalesce(n.cast("bigint"), F.lit(1)), F.lit(1))
    return (
        F.when(part["kind"] == "image", least(patches))
        .when(part["kind"] == "audio", least(F.ceil(part["seconds"] * AUDIO_RATE)))
        .when(part["kind"] == "document", least(part["pages"] * PAGE_TOKENS))
        .otherwise(F.lit(0).cast("bigint"))
    )


def flatten_part(part: Column) -> Column:
    """The visitor: a text part becomes its escaped text, an attachment a placeholder; unknown kinds raise."""
    return (
        F.when(part["kind"] == "text", escape(F.coalesce(part["text"], F.lit(""))))
        .when(part["kind"].isin("image", "audio", "document"), F.concat(F.lit("<|"), part["kind"], F.lit("|>")))
        .otherwise(F.raise_error(F.concat(F.lit("unknown content part: "), F.coalesce(part["kind"], F.lit("null")))))
    )


def format_chats(messages: DataFrame, parts: str = "parts") -> DataFrame:
    """conv_id, formatted, turns, spans, attachments; one row per conversation.

    messages: conv_id, turn, role and a column of parts (null: none); other columns are ignored. Rows stand by turn (null first),
    then by role (null: an empty one) and by the escaped text, so rows that tie in all three are equal. A null conv_id is a
    conversation like any other, a null or empty text an empty turn, and a text of any length is formatted whole. spans: start and length in code points (from 0) of what the loss covers, the
    contents of assistant turns, with the message's place (from 1) and the start within its frame. attachments: message place, part place, kind, ref, start and tokens. Repeated rows
    stay repeated turns. An empty table gives an empty table.

    Turns are formatted where they lie. One shuffle by conv_id brings a conversation's turns together, for its
    formatted string is one value; offsets come from a streaming window, not from an array grown turn by turn.
    """
    content = F.coalesce(F.col(parts), F.array().cast(PARTS))
    one = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("parts"))
    one = one.withColumn("flat", F.transform("parts", flatten_part))
    head = F.concat(F.lit(START), F.url_encode("role"), F.lit("\n"))
    one = one.select(
        "conv_id",
        "turn",
        "role",
        F.length(head).alias("head_len"),
        F.concat(head, F.array_join("flat", ""), F.lit(END)).alias("piece"),
        F.length(F.array_join("flat", "")).alias("body_len"),
        F.filter(
            F.transform(
                "parts",
                lambda p, i: F.struct(
                    i.alias("part"),
                    p["kind"].alias("kind"),
                    p["ref"].alias("ref"),
                    F.length(F.array_join(F.slice("flat", F.lit(1), i), "")).alias("at"),
                    placeholder_tokens(p).alias("tokens"),
                ),
            ),
            lambda a: a["kind"] != "text",
        ).alias("found"),
    )
    ordered = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "piece")
    before = F.coalesce(F.sum(F.length("piece").cast("bigint")).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = one.withColumn("at", before + F.col("head_len")).withColumn("place", F.row_number().over(ordered))
    item = F.struct(
        "place",
        "piece",
        F.when(F.col("role") == "assistant", F.struct(F.col("at").alias("start"), F.col("body_len").cast("bigint").alias("length"), F.col("place").alias("message"), F.col("head_len").alias("within"))).alias("span"),
        F.transform(
            "found",
            lambda a: F.struct(
                F.col("place").alias("message"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"),
                (F.col("at") + a["at"]).alias("start"), a["tokens"].alias("tokens"),
            ),
        ).alias("found"),
    )
    rows = F.array_sort(F.collect_list(item))
    grouped = placed.groupBy("conv_id").agg(rows.alias("rows"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
        F.size("rows").cast("bigint").alias("turns"),
        F.filter(F.transform("rows", lambda r: r["span"]), lambda s: s.isNotNull()).alias("spans"),
        F.flatten(F.transform("rows", lambda r: r["found"])).alias("attachments"),
    )


def frames(formatted: Column) -> Column:
    """A formatted string's messages, each from its start mark up to its end mark."""
    # END is never inside a text, for escape() breaks its first mark
    return F.slice(F.split(formatted, r"<\|im_end\|>\n"), F.lit(1), F.size(F.split(formatted, r"<\|im_end\|>\n")) - 1)


def read_back(found: Column) -> Column:
    """The turns of the frames of text parts: array of (role, text)."""

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        text = F.substring(p, F.length(head) + 2, F.length(p))
        return F.struct(F.url_decode(F.substring(head, F.lit(len(START) + 1), F.length(head))).alias("role"), unescape(text).alias("text"))

    return F.transform(found, turn)


def loss_text(found: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped. Each span is cut from its own frame, so the work is linear in the string."""
    return F.transform(
        F.array(found), lambda f: F.array_join(F.transform(spans, lambda s: unescape(F.substring(F.get(f, s["message"] - 1), s["within"] + 1, s["length"].cast("int")))), "")
    )[0]


def chat_digests(conversations: DataFrame) -> DataFrame:
    """The op7 row of each conversation of (conv_id, turn, role, text), read back from the formatted output."""
    messages = conversations.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))
    out = format_chats(messages).withColumn("frames", frames(F.col("formatted")))
    out = out.withColumns({"back": read_back(F.col("frames")), "loss": loss_text(F.col("frames"), F.col("spans"))})
    turns = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("back").cast("bigint").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
