"""Chat formatting with typed content parts.

A turn is a list of parts (kind, text, ref, size). A fold visits them: text is escaped, any other kind
becomes a numbered placeholder and an attachment record with its expanded token count. Control strings
inside texts, kinds and roles are escaped reversibly; text parts that follow one another are escaped as one text, so
that no control string can be put together from pieces. What is read back has the same roles, texts and placeholders,
with such text parts as one. Null text, kind and role count as empty (a null kind as text); a null part list
has no parts; rows of one turn number follow by role and parts; a null conv_id is one conversation.
A conversation is one row, as its formatted text is.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,size:bigint>"
TURN, END, BREAK = "<|turn|>", "<|end|>", "\n"
TRAINED_ROLE = "assistant"
# Strings that chat templates give a meaning to, and the escapes of their first characters.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<bos>", "<eos>", "<pad>", "<unk>")
ESCAPES = {"<": "&lt;", "[": "&#91;"}
# Tokens that a placeholder stands for: a fixed number, and one for so many units of its size. These depend on the
# model that is trained; the numbers here are those of the query.
EXPANSION = {"image": (64, 1024), "audio": (16, 40), "document": (8, 4)}


def escape(text: Column) -> Column:
    """A text without control strings; ``&`` marks what was changed."""
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for control in CONTROL:
        text = F.replace(text, F.lit(control), F.lit(ESCAPES[control[0]] + control[1:]))
    return text


def unescape(text: Column) -> Column:
    """The text that was escaped."""
    for first, code in ESCAPES.items():
        text = F.replace(text, F.lit(code), F.lit(first))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def _role(role: Column) -> Column:
    return F.replace(escape(F.coalesce(role, F.lit(""))), F.lit(BREAK), F.lit("&#10;"))


# What would end a placeholder early, or a role, and its escapes.
MARKS = {"|": "&#124;", ":": "&#58;", BREAK: "&#10;"}


def _escaped_kind(kind: Column) -> Column:
    out = escape(kind)
    for mark, code in MARKS.items():
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


def _unescaped_kind(kind: Column) -> Column:
    for mark, code in MARKS.items():
        kind = F.replace(kind, F.lit(code), F.lit(mark))
    return unescape(kind)


def expanded(kind: Column, size: Column, expansion: Mapping[str, tuple[int, int]] = EXPANSION) -> Column:
    """Tokens behind a placeholder; none for a kind without a rule."""
    out = F.lit(0).cast("bigint")
    for name, (fixed, unit) in expansion.items():
        out = F.when(kind == name, (fixed + F.ceil(F.coalesce(size, F.lit(0)) / unit)).cast("bigint")).otherwise(out)
    return out


def visit(parts: Column, expansion: Mapping[str, tuple[int, int]] = EXPANSION) -> Column:
    """struct(text, attachments): the parts in order, flattened to escaped text with placeholders."""
    start = F.struct(F.lit("").alias("text"), F.lit("").alias("pending"), F.from_json(
        F.lit("[]"), "array<struct<number:int,kind:string,ref:string,tokens:bigint>>").alias("attachments"))

    def step(s: Column, part: Column) -> Column:
        plain = F.coalesce(part["kind"], F.lit("text")) == "text"
        number = F.size(s["attachments"]) + 1
        mark = F.concat(F.lit("<|"), _escaped_kind(part["kind"]), F.lit(":"), number.cast("string"), F.lit("|>"))
        record = F.struct(number.alias("number"), part["kind"].alias("kind"), part["ref"].alias("ref"),
                          expanded(part["kind"], part["size"], expansion).alias("tokens"))
        return F.struct(
            F.when(plain, s["text"]).otherwise(F.concat(s["text"], escape(s["pending"]), mark)).alias("text"),
            F.when(plain, F.concat(s["pending"], F.coalesce(part["text"], F.lit("")))).otherwise("").alias("pending"),
            F.when(plain, s["attachments"]).otherwise(F.concat(s["attachments"], F.array(record))).alias("attachments"))

    return F.aggregate(F.coalesce(parts, F.array().cast(f"array<{PART}>")), start, step, lambda s: F.struct(
        F.concat(s["text"], escape(s["pending"])).alias("text"), s["attachments"].alias("attachments")))


def text_part(text: Column) -> Column:
    """A turn of one text part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
                            null.cast("string").alias("ref"), null.cast("bigint").alias("size")))


def format_conversations(turns: DataFrame, expansion: Mapping[str, tuple[int, int]] = EXPANSION) -> DataFrame:
    """``turns(conv_id, turn, role, parts)`` to one row per conversation: conv_id, formatted, loss (spans of
    code points, end exclusive, of what the trained role says), attachments, expanded_tokens."""
    content = visit(F.col("parts"), expansion)
    rows = turns.select("conv_id", F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("content")).alias("t"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def head(t: Column) -> Column:
        return F.concat(F.lit(TURN), _role(t["role"]), F.lit(BREAK))

    pieces = F.transform("turns", lambda t: F.struct(
        F.concat(head(t), t["content"]["text"], F.lit(END + BREAK)).alias("piece"),
        F.length(head(t)).alias("before"), F.length(t["content"]["text"]).alias("chars"),
        (t["role"] == TRAINED_ROLE).alias("trained")))
    spans = F.from_json(F.lit("[]"), "array<struct<start:bigint,end:bigint>>")

    def mark(s: Column, p: Column) -> Column:
        first = s["at"] + p["before"]
        span = F.struct(first.alias("start"), (first + p["chars"]).alias("end"))
        return F.struct((s["at"] + F.length(p["piece"])).alias("at"),
                        F.when(p["trained"], F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    out = listed.withColumn("pieces", pieces)
    attachments = F.flatten(F.transform("turns", lambda t: t["content"]["attachments"]))
    return out.select(
        "conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        F.aggregate("pieces", F.struct(F.lit(0).cast("bigint").alias("at"), spans.alias("spans")), mark,
                    lambda s: s["spans"]).alias("loss"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"))


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted text: array of struct(role, text, parts), unescaped; placeholders stay in ``text``."""
    pieces = F.split(formatted, r"<\|end\|>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def read(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(TURN) + 1), F.length(piece))
        at = F.instr(body, F.lit(BREAK))
        role = F.replace(F.substring(body, F.lit(1), at - 1), F.lit("&#10;"), F.lit(BREAK))
        text = F.substring(body, at + 1, F.length(body))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"), read_parts(text).alias("parts"))

    return F.transform(pieces, read)


def read_parts(text: Column) -> Column:
    """Parts of a turn's text as it stands in the formatted text: array of struct(kind, text, number). No escaped text
    holds ``<|``, so each one is a placeholder; its number counts the attachments of the turn."""

    def placed(kind: Column, body: Column, number: Column) -> Column:
        return F.struct(kind.alias("kind"), body.alias("text"), number.alias("number"))

    def read(piece: Column, k: Column) -> Column:
        mark = F.substring_index(piece, "|>", 1)
        rest = F.substring(piece, F.length(mark) + 3, F.length(piece))
        behind = F.array(placed(F.lit("text"), unescape(rest), F.lit(None).cast("int")))
        own = F.array(placed(_unescaped_kind(F.substring_index(mark, ":", 1)), F.lit(None).cast("string"),
                             F.substring_index(mark, ":", -1).cast("int")))
        first = F.array(placed(F.lit("text"), unescape(piece), F.lit(None).cast("int")))
        return F.when(k == 0, first).otherwise(F.concat(own, behind))

    found = F.flatten(F.transform(F.split(text, r"<\|"), read))
    return F.filter(found, lambda p: p["number"].isNotNull() | (p["text"] != ""))


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(
        formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted text: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, expanded_tokens."""
    turns = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role",
                                 text_part(F.col("text")).alias("parts"))
    done = format_conversations(turns).withColumn("turns", read_turns(F.col("formatted"))).withColumn(
        "masked", masked_text(F.col("formatted"), F.col("loss")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("masked").cast("bigint").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "expanded_tokens")
