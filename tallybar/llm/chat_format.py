"""Chat formatting: typed content parts, flattened by one visitor, in DataFrame functions only.

A turn is ``<|start|>role`` + newline + content + ``<|end|>`` + newline. A text part is escaped: every backslash is
doubled, and a backslash is put behind the first character of each control string, so that no text can hold one;
dropping each backslash and keeping what follows it undoes this. Image, audio and document parts become the ordered
placeholders ``<|image|>``, ``<|audio|>`` and ``<|document|>``; their references and the tokens that they expand to
are recorded beside the text. Assistant turns are under the loss mask.

Defined results: null roles and texts count as empty; turns are ordered by (turn, role, parts as they came), nulls first; repeated
rows are repeated turns; rows with a null conv_id form one conversation; parts of an unknown type count as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|start|>", "<|end|>"
#: Control strings: a first character and what makes it one. The same pattern serves Java and RE2.
CONTROL = r"(<|\[)(\||/?s>|/?INST\]|</?SYS>>)"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Expanded tokens: an image by tiles of this many pixels a side, audio by tokens a second, a document by tokens a page.
IMAGE_TILE, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(doubled, CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A one-part content from a plain text."""
    return F.array(F.struct(
        F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
        F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
    ))


def _kind(part: Column) -> Column:
    return F.when(part["type"].isin("image", "audio", "document"), part["type"]).otherwise("text")


def part_tokens(part: Column) -> Column:
    """How many tokens the placeholder of an attachment expands to; 0 for text."""
    tiles = F.ceil(F.coalesce(part["width"], F.lit(0)) / IMAGE_TILE) * F.ceil(F.coalesce(part["height"], F.lit(0)) / IMAGE_TILE)
    return (
        F.when(part["type"] == "image", tiles)
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS)
        .otherwise(0)
        .cast("long")
    )


def flatten_parts(parts: Column) -> Column:
    """The content of a turn: escaped texts and placeholders in order."""
    visit = lambda p: F.when(_kind(p) == "text", escape(p["text"])).otherwise(F.concat(F.lit("<|"), p["type"], F.lit("|>")))
    return F.array_join(F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), visit), "")


def attachments(parts: Column) -> Column:
    """The attachments of a turn in order: kind, reference and expanded tokens."""
    held = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: _kind(p) != "text")
    return F.transform(held, lambda p: F.struct(p["type"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, formatted and attachments of each conversation, from (conv_id, turn, role, parts).

    A conversation is one text, so its turns meet in one row; nothing else does.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.array().cast(f"array<{PART}>")).cast(f"array<{PART}>").alias("parts"))
    grouped = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    head = lambda t: F.regexp_replace(escape(t["role"]), "\n", "\\\\\n")
    one = lambda t: F.concat(F.lit(START), head(t), F.lit("\n"), flatten_parts(t["parts"]), F.lit(END + "\n"))
    return grouped.select("conv_id", F.array_join(F.transform("t", one), "").alias("formatted"), F.flatten(F.transform("t", lambda t: attachments(t["parts"]))).alias("attachments"))


def parse_turns(formatted: Column) -> Column:
    """Read a formatted conversation back: array of (role, text, loss); placeholders stay in the text."""
    head = r"(?s)\A((?:[^\\\n]++|\\.)*+)\n(.*)<\|end\|>\n\z"
    segments = F.filter(F.split(formatted, r"<\|start\|>"), lambda s: s != "")
    role = lambda s: unescape(F.regexp_extract(s, head, 1))
    return F.transform(segments, lambda s: F.struct(role(s).alias("role"), unescape(F.regexp_extract(s, head, 2)).alias("text"), (role(s) == "assistant").alias("loss")))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, read back from its formatted text."""
    read = formatted.select("conv_id", "formatted", parse_turns(F.col("formatted")).alias("turns"))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
