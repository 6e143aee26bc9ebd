"""Text cleaning as column expressions; only the decoding of rare charsets runs Python, in Arrow batches.

A function uses its argument once where it can: an argument repeated in an expression is evaluated
again, and nested functions would multiply that.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from postloom import fixed

# One token of an HTML document, first alternative wins. Repeated groups are possessive so that
# long tags neither backtrack nor grow the matcher's stack.
_ATTRS = r"""(?:[^>'"]++|'[^']*+(?:'|\z)|"[^"]*+(?:"|\z))*+(?:>|\z)"""
_TO_GT = r"[^>]*+(?:>|\z)"
_HTML_TOKEN = "(?is)" + "|".join([
    r"<!--.*?(?:-->|\z)",                                # comment
    r"<!\[(?-i:CDATA)\[.*?\]\]>",                        # closed CDATA
    r"<!\[(?-i:CDATA)\[[^>]*+>",                         # open CDATA, skipped up to '>'
    r"<!\[(?-i:CDATA)\[",                                # open CDATA without any '>'
    r"<!" + _ATTRS,                                      # doctype and the like
    rf"<script(?![a-z0-9-]){_TO_GT}(?:.*?</script(?=.){_TO_GT}|.*)",
    rf"<style(?![a-z0-9-]){_TO_GT}(?:.*?</style(?=.){_TO_GT}|.*)",
    rf"</{_TO_GT}",                                      # closing tag
    r"<[a-z]" + _ATTRS,                                  # opening tag
    r"[^<]++",                                           # text
    r"<",                                                # a '<' that opens nothing
])
_BLOCK_TOKEN = r"(?i)^</?(?:" + "|".join(fixed.BLOCK_TAGS) + r")(?![a-z0-9-])"
_CDATA = "<![CDATA["
_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
# '&' up to the next ';' (or to the end, then it names nothing), else text
_ENTITY_TOKEN = r"&[^;]*+(?:;|\z)|[^&]++"
_ENTITY_TABLE = "\n".join(f"{name}\t{char}" for name, char in fixed.ENTITIES.items())
_NAMED_ENTITY = "^&(?:" + "|".join(fixed.ENTITIES) + ");$"


def trim_space(c: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(c, F.lit(fixed.WHITE_SPACE))


def collapse_newlines(c: Column) -> Column:
    """Runs of newlines become one."""
    return F.regexp_replace(c, r"\n+", "\n")


def trim_lines(c: Column) -> Column:
    """Trim every line, keeping the line count."""
    return F.array_join(F.transform(F.split(c, "\n"), trim_space), "\n")


def tidy_lines(c: Column) -> Column:
    """Trimmed, non-empty lines only."""
    lines = F.transform(F.split(c, "\n"), trim_space)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def _html_token_text(token: Column) -> Column:
    return (
        F.when(~token.startswith("<") | (token == "<"), token)
        .when(token == _CDATA, F.lit(_CDATA[1:]))
        .when(token.startswith(_CDATA) & token.endswith("]]>"),
              F.substring(token, F.lit(10), F.length(token) - 12))
        .when(token.rlike(_BLOCK_TOKEN), F.lit("\n"))
        .otherwise(F.lit(""))
    )


def strip_html(c: Column) -> Column:
    """Text of an HTML document: tags, scripts, styles and comments removed, blocks on own lines."""
    tokens = F.regexp_extract_all(c, F.lit(_HTML_TOKEN), F.lit(0))
    text = F.array_join(F.transform(tokens, _html_token_text), "")
    return tidy_lines(text)


def strip_control_chars(c: Column) -> Column:
    """Drop C0/C1 control characters and DEL except tab, newline, carriage return."""
    return F.regexp_replace(c, _CONTROL, "")


def _code_point_text(token: Column) -> Column:
    """Character of a numeric entity token, or the token itself when it names none."""
    hexadecimal = F.substring(token, 3, 1).isin("x", "X")
    hex_digits = F.regexp_replace(
        F.substring(token, F.lit(4), F.length(token) - 4), "[^0-9A-Fa-f]", "0")
    # the code point is an unsigned 32-bit number: only the last eight hex digits count
    hex_value = F.conv(F.right(hex_digits, F.lit(8)), 16, 10).cast("bigint")
    digits = F.regexp_replace(token, "[^0-9]", "")
    dec_value = F.aggregate(
        F.filter(F.split(digits, ""), lambda d: d != ""),
        F.lit(0).cast("bigint"),
        lambda acc, d: F.pmod(acc * 10 + d.cast("bigint"), F.lit(4294967296)),
    )
    cp = F.when(hexadecimal, hex_value).otherwise(dec_value)
    char = F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")
    is_char = (cp > 0) & (cp <= 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
    return F.when(is_char, char).otherwise(token)


def _entity_text(token: Column) -> Column:
    table = F.str_to_map(F.lit(_ENTITY_TABLE), F.lit("\n"), F.lit("\t"))
    name = F.substring(token, F.lit(2), F.length(token) - 2)
    return (
        F.when(~token.startswith("&"), token)
        .when(token.startswith("&#") & token.endswith(";") & (F.length(token) > 3),
              _code_point_text(token))
        .when(token.rlike(_NAMED_ENTITY), F.element_at(table, name))
        .otherwise(token)
    )


def decode_entities(c: Column) -> Column:
    """Named and numeric HTML entities to characters, in one pass.

    A candidate runs from '&' to the next ';'; what it yields is not decoded again.
    """
    tokens = F.regexp_extract_all(c, F.lit(_ENTITY_TOKEN), F.lit(0))
    return F.array_join(F.transform(tokens, _entity_text), "")


def sanitize_header(c: Column) -> Column:
    """Clean a short header such as a subject. Most headers hold nothing to clean and are only
    trimmed."""
    cleaned = trim_space(decode_entities(strip_control_chars(strip_html(c))))
    return F.when(c.rlike(r"[<&\x00-\x1F\x7F-\x9F]"), cleaned).otherwise(trim_space(c))


def sanitize_address_field(c: Column) -> Column:
    """Clean an address list; angle brackets are kept."""
    cleaned = trim_space(decode_entities(strip_control_chars(c)))
    return F.when(c.rlike(r"[&\x00-\x1F\x7F-\x9F]"), cleaned).otherwise(trim_space(c))


def sanitize_body(c: Column) -> Column:
    """Trim, then drop code points below 32 except newline, tab, carriage return."""
    return F.regexp_replace(trim_space(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def truncate(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last one an ellipsis when cut."""
    if limit <= 0:
        return F.lit("")
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit - 1)), F.lit("…"))).otherwise(c)


def excerpt(c: Column, limit: int) -> Column:
    """First ``limit`` characters and an ellipsis; no limit when not positive."""
    if limit <= 0:
        return c
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("…"))).otherwise(c)


def clip_error(c: Column) -> Column:
    """Error text for a highlight line."""
    kept = F.concat(F.left(c, F.lit(fixed.HIGHLIGHT_ERROR_KEEP)), F.lit("..."))
    return F.when(F.length(c) > fixed.HIGHLIGHT_ERROR_LIMIT, kept).otherwise(c)


def first_non_blank(*cols: Column) -> Column:
    """First argument that is not blank, else the empty string."""
    picked = [F.when(trim_space(c) != "", c) for c in cols]
    return F.coalesce(*picked, F.lit(""))


def quoted(c: Column) -> Column:
    """Double-quoted text; quotes, backslashes, line breaks and characters that do not print are escaped."""
    escaped = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for char, short in (("\a", "\\a"), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"),
                        ("\t", "\\t"), ("\v", "\\v")):
        escaped = F.replace(escaped, F.lit(char), F.lit(short))

    def printed(x: Column) -> Column:
        code = F.ascii(x)
        digits = F.lower(F.hex(code))
        return (F.when(~x.rlike(r"[\p{C}\p{Z}&&[^ ]]"), x)
                .when(code < 128, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0")))
                .when(code < 65536, F.concat(F.lit("\\u"), F.lpad(digits, 4, "0")))
                .otherwise(F.concat(F.lit("\\U"), F.lpad(digits, 8, "0"))))

    odd = F.array_join(F.transform(F.split(escaped, ""), printed), "")
    escaped = F.when(escaped.rlike(r"[\p{C}\p{Z}&&[^ ]]"), odd).otherwise(escaped)
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def redact(c: Column, secrets: list[str]) -> Column:
    """Replace every literal secret by ``[REDACTED]`` (longest secret first)."""
    literals = sorted({s for s in secrets if s}, key=lambda s: (-len(s), s))
    if not literals:
        return c
    pattern = "|".join("\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E" for s in literals)
    return F.regexp_replace(c, pattern, "[REDACTED]")


@pandas_udf(StringType())
def _decoded(raw: pd.Series, charset: pd.Series) -> pd.Series:
    return pd.Series([None if data is None else decode_bytes(data, name) for data, name in zip(raw, charset)],
                     dtype="object")


def decode_bytes(data: bytes, charset: str | None) -> str | None:
    """Bytes in any known charset; bad bytes are replaced, an unknown charset gives nothing."""
    try:
        return bytes(data).decode((charset or "utf-8").strip(), errors="replace")
    except (LookupError, ValueError, TypeError):
        return None


# Charsets that column expressions read (names in lower case); any other goes through Python.
UTF8, ASCII, LATIN = ("utf-8", "utf8"), ("us-ascii", "ascii"), ("iso-8859-1", "latin1", "latin-1")


def convert_charset(raw: Column, charset: Column | str = "UTF-8") -> Column:
    """Bytes to text; the charset may differ by row. A row never ends the job: bad bytes become the
    replacement character, an unknown charset gives null, a null one means UTF-8. Bytes in UTF-8, ASCII and Latin-1 are
    read by column expressions; only those of other charsets go to Python, in Arrow batches."""
    given = F.lit(charset) if isinstance(charset, str) else charset
    name = F.lower(F.trim(F.coalesce(given, F.lit("utf-8"))))
    latin = F.decode(raw, "ISO-8859-1")
    other = F.when(~name.isin(*UTF8, *ASCII, *LATIN), raw)
    return (F.when(name.isin(*UTF8), F.make_valid_utf8(raw.cast("string")))
            .when(name.isin(*ASCII), F.regexp_replace(latin, r"[\x80-\xFF]", "\uFFFD"))
            .when(name.isin(*LATIN), latin).otherwise(_decoded(other, given)))


def payload_hash(c: Column) -> Column:
    """SHA-256 hex digest."""
    return F.sha2(c, 256)


def label_list(labels: tuple[str, ...] | list[str]) -> str:
    """Bulleted label list; the default labels when none are given."""
    return "\n".join(f"- {name}" for name in (labels or fixed.PROMPT_LABELS))


def join_labels(c: Column) -> Column:
    """Comma-separated labels."""
    return F.array_join(c, ", ")
