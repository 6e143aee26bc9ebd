"""Sender parsing and address formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.text import sanitize_header, trim_space


# behind the last '<' up to the last '>', or behind an unclosed '<'
_BRACKETED = r"(?s)^(?:.*<([^<]*)>[^<>]*|[^>]*<([^<>]*))\z"
_ADDRESS = r"(?s)^(.+@[^@]+)\z"


def extract_address(c: Column) -> Column:
    """Text between the last '<' and the last '>' behind it, or behind an unclosed '<'; else the
    whole trimmed value."""
    inner = trim_space(F.regexp_replace(trim_space(c), _BRACKETED, "$1$2"))
    return F.when(F.contains(c, F.lit("<")), inner).otherwise(trim_space(c))


def sender(c: Column) -> Column:
    """Sender address with its case kept; empty when the header holds none."""
    return F.regexp_extract(extract_address(c), _ADDRESS, 1)


def senders(c: Column) -> Column:
    """The sender as a list of one or none: exploding it parses and filters in one step."""
    return F.regexp_extract_all(extract_address(c), F.lit(_ADDRESS), F.lit(1))


def sender_domain(sender_address: Column) -> Column:
    """Lower-cased domain of an address from ``sender``; empty for an empty address."""
    return F.lower(F.substring_index(sender_address, "@", -1))


def format_address(name: Column, mailbox: Column, host: Column) -> Column:
    """``Name <box@host>``, or ``box@host`` without a name."""
    box = F.concat(mailbox, F.lit("@"), host)
    named = F.concat(sanitize_header(name), F.lit(" <"), box, F.lit(">"))
    return F.when(F.coalesce(name, F.lit("")) != "", named).otherwise(box)


def format_address_list(addresses: Column) -> Column:
    """Comma-separated list from ``ARRAY<STRUCT<name, mailbox, host>>``."""
    parts = F.transform(addresses, lambda a: format_address(a["name"], a["mailbox"], a["host"]))
    return F.coalesce(F.array_join(parts, ", "), F.lit(""))


def message_key(account: Column, uid: Column) -> Column:
    """``account/uid``."""
    return F.concat_ws("/", account, uid.cast("string"))
