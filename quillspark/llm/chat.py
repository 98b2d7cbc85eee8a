"""Chat formatting with typed content parts, in native expressions only.

A visitor flattens the parts of a turn into one string: text is escaped, an image, audio or
document part becomes a numbered placeholder, and its reference and expanded token count are
recorded. A turn is ``### <role>: <content> </turn>\\n``. In contents and roles every backslash,
``#`` and ``<`` is written as ``\\e``, ``\\h`` and ``\\l`` (in roles ``:`` as ``\\c``), so no
control string of the template can occur inside them and unescape() is exact.

The loss mask has one (start, length) per turn, in code points from the start of that turn;
length 0 where there is no loss. Rows of a conversation are ordered by turn, then role, then
text; equal rows are all kept. Null text is empty, null role is the empty role, rows with a null
conv_id form one conversation. A conversation is the unit of output, so its rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, COLON, TAIL = "### ", ": ", " </turn>\n"
#: The parts' type; a text part uses text, the others ref and their measures.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Expanded tokens: an image has one per square patch of so many pixels, audio and documents a fixed rate.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512
_ESCAPES = (("\\", "\\e"), ("#", "\\h"), ("<", "\\l"))


def escape(text: Column) -> Column:
    for raw, safe in _ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(_ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


def text_parts(text: Column) -> Column:
    """Plain text as an array of one text part."""
    null = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null("string").alias("ref"), null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages")))


def expanded_tokens(part: Column) -> Column:
    """Tokens that a non-text part stands for; unknown measures count as the least."""
    patches = lambda side: F.ceil(F.greatest(F.coalesce(part[side], F.lit(1)), F.lit(1)) / PATCH)
    return (
        F.when(part["type"] == "image", patches("width") * patches("height"))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(1)) * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def attachments(parts: Column) -> Column:
    """(ordinal, type, ref, tokens) of the non-text parts, in order; ordinals start at 1."""
    other = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: ~p["type"].eqNullSafe("text"))
    return F.transform(other, lambda p, i: F.struct((i + 1).alias("ordinal"), p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))


def flatten(parts: Column) -> Column:
    """The content string of a turn: escaped texts and placeholders in the order of the parts."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    ordinal = lambda i: F.size(F.filter(F.slice(parts, 1, i + 1), lambda p: ~p["type"].eqNullSafe("text")))
    place = lambda p, i: F.concat(F.lit("<|"), escape(F.coalesce(p["type"], F.lit("part"))), F.lit(":"), ordinal(i).cast("string"), F.lit("|>"))
    return F.array_join(F.transform(parts, lambda p, i: F.when(p["type"].eqNullSafe("text"), escape(F.coalesce(p["text"], F.lit("")))).otherwise(place(p, i))), "")


def format_chats(rows: DataFrame, parts: Column, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conv_id: formatted, loss_mask, attachments and expanded_tokens."""
    role = F.coalesce(F.col("role"), F.lit(""))
    flat = rows.select("conv_id", "turn", role.alias("role"), flatten(parts).alias("content"), attachments(parts).alias("files"))
    turns = flat.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content", "files"))).alias("turns"))
    head = lambda t: F.concat(F.lit(HEAD), escape_role(t["role"]), F.lit(COLON))
    mask = lambda t: F.struct((F.length(head(t)) + 1).alias("start"), F.when(t["role"].isin(*loss_roles), F.length(t["content"])).otherwise(F.lit(0)).alias("length"))
    files = F.flatten(F.transform("turns", lambda t, i: F.transform(t["files"], lambda a: F.struct(i.alias("turn_index"), a["ordinal"].alias("ordinal"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["content"], F.lit(TAIL))), "").alias("formatted"),
        F.transform("turns", mask).alias("loss_mask"),
        files.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parses the output: conv_id, turns (array of role, text) and loss (array of unescaped texts under the mask)."""
    pieces = F.split("formatted", TAIL)
    body = formatted.withColumn("_pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))
    colon = lambda p: F.instr(p, COLON)
    turn = lambda p: F.struct(
        unescape_role(F.substring(p, F.lit(len(HEAD) + 1), colon(p) - len(HEAD) - 1)).alias("role"),
        unescape(F.substring(p, colon(p) + len(COLON), F.length(p))).alias("text"),
    )
    covered = F.filter(F.arrays_zip(F.col("_pieces").alias("piece"), F.col("loss_mask").alias("mask")), lambda x: x["mask"]["length"] > 0)
    loss = F.transform(covered, lambda x: unescape(F.substring(x["piece"], x["mask"]["start"], x["mask"]["length"])))
    return body.withColumn("turns", F.transform("_pieces", turn)).withColumn("loss", loss).drop("_pieces")
