"""Decoding of raw mail messages, in the row of the message: nothing is shuffled and equal keys stay apart.

Heads, parts, transfer encodings, HTML stripping, entity decoding and the choice of the body are column expressions.
Python, in Arrow batches, walks only messages with other charsets, encoded file names or deep nesting.
"""

from __future__ import annotations

from collections.abc import Iterator
from email import message_from_bytes, policy
from email.header import decode_header, make_header
from email.message import Message

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import (ASCII, LATIN, UTF8, decode_bytes, decode_entities, strip_control_chars, strip_html,
                                     trim_space)

LEAVES = ("array<struct<mime_type:string,filename:string,is_attachment:boolean,size:bigint,text:string>>")


def _parts(message: Message) -> Iterator[Message]:
    """Leaves in order; a nested mail is one leaf."""
    if message.get_content_maintype() == "multipart" and message.is_multipart():
        for part in message.get_payload():
            yield from _parts(part)
    else:
        yield message


def _payload(part: Message) -> bytes:
    if part.is_multipart():  # a nested mail
        return b"".join(inner.as_bytes() for inner in part.get_payload())
    return part.get_payload(decode=True) or b""


def _filename(part: Message) -> str | None:
    name = part.get_filename()
    return None if name is None else str(make_header(decode_header(name)))


def _leaf(part: Message) -> tuple | None:
    """A leaf, or nothing for a part that cannot be read."""
    try:
        mime, filename = part.get_content_type(), _filename(part)
        attached = (part.get_content_disposition() == "attachment" or filename is not None
                    or mime == "message/rfc822")
        payload, text = _payload(part), None
        if mime.startswith("text/") and not attached:
            text = decode_bytes(payload, str(part.get_param("charset") or "utf-8"))
        return mime, filename or "", attached, len(payload), text
    except (LookupError, ValueError, TypeError, AttributeError):
        return None


def _leaves(raw: bytes | None) -> list[tuple]:
    if raw is None:
        return []
    found = (_leaf(p) for p in _parts(message_from_bytes(bytes(raw), policy=policy.compat32)))
    return [leaf for leaf in found if leaf is not None]


# A header block: lines with a name, and the lines that go on with blank space. Possessive, so that long heads
# neither backtrack nor grow the matcher's stack.
_HEAD = r"^(?:[\x21-\x39\x3B-\x7E]++[ \t]*+:[^\n]*+(?:\n|\z)(?:[ \t][^\n]*+(?:\n|\z))*+)*+"
_PLAIN = ("", "7bit", "8bit", "binary")
# Levels of multiparts that are cut in columns; deeper ones go to the walk in Python.
LEVELS = 3
# A length that reaches the end of any text.
_END = 2**31 - 1


def _let(value: Column, use) -> Column:
    """``use(value)``, the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _after(text: Column, start: Column | int) -> Column:
    """``text`` from a place on, without a line end that stands there."""
    def line(rest: Column) -> Column:
        return F.when(rest.startswith("\r\n"), F.substring(rest, 3, _END)).when(
            rest.startswith("\n"), F.substring(rest, 2, _END)).otherwise(rest)

    return _let(F.substring(text, F.lit(start) if isinstance(start, int) else start, F.lit(_END)), line)


def _part(text: Column) -> Column:
    """struct(head, body) of a message or part; the head is unfolded. Bytes are characters 0 to 255 here.

    A head ends before the first blank line, so what is behind that is not given to the regular expression.
    """
    top = F.concat(F.substring_index(F.substring_index(text, "\n\r\n", 1), "\n\n", 1), F.lit("\n"))
    return _let(F.regexp_extract(top, _HEAD, 0), lambda head: F.struct(
        F.regexp_replace(head, r"\r?\n(?=[ \t])", "").alias("head"), _after(text, F.length(head) + 1).alias("body")))


def _header(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"(?im)^{name}[ \t]*:[ \t]*([^\r\n]*)", 1)


def _parameter(value: Column, name: str) -> Column:
    """A parameter of a header, null where it has none."""
    pattern = rf'(?i);\s*{name}\s*=\s*(?:"((?:[^"\\]|\\.)*+)"|([^;\s]*+))'
    text = F.concat(F.regexp_replace(F.regexp_extract(value, pattern, 1), r"\\(.)", "$1"),
                    F.regexp_extract(value, pattern, 2))
    return F.when(value.rlike(pattern), text)


def _type(head: Column) -> Column:
    """The content type; text/plain where it is missing or no type."""
    given = F.lower(F.trim(F.substring_index(_header(head, "content-type"), ";", 1)))
    return F.when(given.rlike("^[^/]+/[^/]+$"), given).otherwise(F.lit("text/plain"))


def _cut(part: Column) -> Column:
    """The parts of a multipart between its boundaries, or the part alone."""
    def between(boundary: Column) -> Column:
        mark = F.concat(F.lit("\r?\n--\\Q"), boundary, F.lit("\\E"))
        whole = F.get(F.split(F.concat(F.lit("\n"), part["body"]), F.concat(mark, F.lit("--[ \\t]*(?:\r?\n|\\z)")), 2), F.lit(0))
        pieces = F.split(whole, F.concat(mark, F.lit("[ \\t]*(?=\r?\n|\\z)")), -1)
        return _let(pieces, lambda found: F.transform(
            F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))), lambda p: _let(_after(p, 1), _part)))

    def inner(content: Column) -> Column:
        return _let(_parameter(content, "boundary"), lambda boundary: F.when(
            F.coalesce(boundary, F.lit("")) != "", between(boundary)))

    # most parts are no multiparts, and their heads are looked at no further
    several = F.lower(part["head"]).contains("multipart/") & _type(part["head"]).startswith("multipart/")
    return F.when(several, _let(_let(_header(part["head"], "content-type"), inner), lambda found: F.when(
        F.size(found) > 0, found).otherwise(F.array(part)))).otherwise(F.array(part))


def _unquoted(text: Column) -> Column:
    """Quoted-printable: soft line ends go, ``=XX`` is a byte, any other ``=`` stays."""
    def piece(p: Column, i: Column) -> Column:
        code = F.chr(F.conv(F.substring(p, 1, 2), 16, 10).cast("bigint"))
        code = F.when(F.substring(p, 1, 2) == "00", F.lit("\0")).otherwise(code)
        return (F.when(i == 0, p)
                .when(p.rlike(r"^[0-9A-Fa-f]{2}"), F.concat(code, F.substring(p, F.lit(3), F.length(p))))
                .when(p.rlike(r"^[ \t]*\r?\n"), F.regexp_replace(p, r"^[ \t]*\r?\n", ""))
                .otherwise(F.concat(F.lit("="), p)))

    return F.array_join(F.transform(F.split(text, "="), piece), "")


def _native_leaf(part: Column) -> Column:
    """struct(leaf, odd): a leaf, and whether it needs the walk in Python: other charsets and encodings, encoded or
    continued file names, types of multiparts that change their parts."""
    def leaf(h: Column) -> Column:
        given = F.coalesce(_parameter(h["disposition"], "filename"), _parameter(h["content"], "name"))
        attached = (F.lower(F.trim(F.substring_index(h["disposition"], ";", 1))) == "attachment") | given.isNotNull() | (
            h["type"] == "message/rfc822")
        packed = F.regexp_replace(part["body"], "[^A-Za-z0-9+/=]", "")
        unpacked = F.decode(F.try_to_binary(packed, F.lit("base64")), "ISO-8859-1")
        payload = F.when(h["encoding"] == "base64", unpacked).when(
            h["encoding"] == "quoted-printable", _unquoted(part["body"])).otherwise(part["body"])
        charset = F.coalesce(F.lower(F.trim(_parameter(h["content"], "charset"))), F.lit("utf-8"))
        is_text = h["type"].startswith("text/") & ~attached

        def read(data: Column) -> Column:
            text = (F.when(charset.isin(*UTF8), F.make_valid_utf8(F.encode(data, "ISO-8859-1").cast("string")))
                    .when(charset.isin(*ASCII), F.regexp_replace(data, r"[\x80-\xFF]", "\uFFFD")).otherwise(data))
            odd = (data.isNull() | ~h["encoding"].isin(*_PLAIN, "base64", "quoted-printable")
                   | (is_text & ~charset.isin(*UTF8, *ASCII, *LATIN)) | (h["type"] == "multipart/digest")
                   | F.coalesce(given, F.lit("")).contains("=?") | F.concat_ws(";", h["content"], h["disposition"]).rlike(
                       r"(?i);\s*(?:file)?name\*") | given.rlike(r"[\x80-\xFF]"))
            return F.struct(
                F.struct(h["type"].alias("mime_type"), F.coalesce(given, F.lit("")).alias("filename"),
                         attached.alias("is_attachment"), F.length(data).cast("bigint").alias("size"),
                         F.when(is_text, text).alias("text")).alias("leaf"),
                F.coalesce(odd, F.lit(False)).alias("odd"))

        return _let(payload, read)

    heads = F.struct(_header(part["head"], "content-type").alias("content"), _type(part["head"]).alias("type"),
                     _header(part["head"], "content-disposition").alias("disposition"),
                     F.lower(F.trim(_header(part["head"], "content-transfer-encoding"))).alias("encoding"))
    return _let(heads, leaf)


def message_leaves(raw: DataFrame, column: str = "raw") -> DataFrame:
    """``raw`` with the MIME leaves of each message as ``leaves`` in place of the binary column.

    Heads, boundaries, transfer encodings and the common charsets are column expressions in the message's row. Messages
    with an odd leaf, or multiparts nested deeper than ``LEVELS``, go through the walk in Python instead.
    """

    @F.pandas_udf(LEAVES)
    def walked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_leaves(data) for data in batch], dtype="object")

    rows = raw.withColumn("_parts", F.array(_let(F.decode(F.col(column), "ISO-8859-1"), _part)))
    for _ in range(LEVELS):
        rows = rows.withColumn("_parts", F.flatten(F.transform("_parts", _cut)))
    rows = rows.withColumn("_leaves", F.transform("_parts", _native_leaf))
    deeper = F.exists("_parts", lambda p: F.size(_cut(p)) > 1)
    odd = F.exists("_leaves", lambda x: x["odd"]) | deeper
    rows = rows.withColumn("_odd", F.coalesce(odd, F.lit(False))).drop("_parts")
    native = F.coalesce(F.transform("_leaves", lambda x: x["leaf"]), F.array().cast(LEAVES))
    own = walked(F.when(F.col("_odd"), F.col(column)))
    return rows.withColumn("leaves", F.when(F.col("_odd"), own).otherwise(native)).drop(column, "_leaves", "_odd")


def bodies_and_attachments(decoded: DataFrame) -> DataFrame:
    """Body = first non-empty text leaf, cleaned; attachments in leaf order. One row per message."""
    # the first leaf with text decides; only HTML that strips to nothing lets the next one try
    texts = F.filter("leaves", lambda x: F.coalesce(x["text"], F.lit("")) != "")

    def plain(x: Column) -> Column:
        return F.when(x["mime_type"] == "text/html", strip_html(x["text"])).otherwise(x["text"])

    def any_plain(found: Column) -> Column:
        return _let(plain(F.get(found, F.lit(0))), lambda first: F.when(first != "", first).otherwise(
            F.get(F.filter(F.transform(found, plain), lambda x: x != ""), F.lit(0))))

    body = _let(texts, any_plain)
    found = F.transform(F.filter("leaves", lambda x: x["is_attachment"]), lambda x: F.struct(
        x["filename"].alias("filename"), x["mime_type"].alias("mime_type"), x["size"].alias("size")))
    clean = _let(strip_control_chars(F.coalesce(body, F.lit(""))), lambda x: trim_space(
        F.when(F.contains(x, F.lit("&")), decode_entities(x)).otherwise(x)))
    return decoded.withColumns({"body": clean, "attachments": found}).drop("leaves")
