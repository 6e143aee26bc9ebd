"""Scalar clean-up of classifier replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom import fixed
from postloom.functions.text import trim_space


def strip_fences(c: Column) -> Column:
    """Drop a leading code fence and everything from the last fence on."""
    opened = F.regexp_replace(trim_space(c), r"^```(?:json)?", "")
    bare = trim_space(F.regexp_replace(opened, r"(?s)^(.*)```.*\z", "$1"))
    return F.when(F.contains(c, F.lit("```")), bare).otherwise(trim_space(c))


def json_part(c: Column) -> Column:
    """From the first '{' to the last '}', or the trimmed text when there is no such span."""
    trimmed = trim_space(c)
    span = F.regexp_replace(trimmed, r"(?s)^[^{]*(\{.*\})[^}]*\z", "$1")
    return F.when(trimmed.startswith("{") & trimmed.endswith("}"), trimmed).otherwise(span)


def lower_trim(c: Column) -> Column:
    return F.lower(trim_space(c))


def legacy_urgency(c: Column) -> Column:
    """Older replies say ``normal`` where ``medium`` is meant."""
    value = lower_trim(c)
    return F.when(value == "normal", F.lit("medium")).otherwise(value)


def effective_priority(priority: Column, urgency: Column) -> Column:
    """Normalised priority; the urgency stands in only for a blank priority."""
    own = lower_trim(priority)
    return F.when((own == "") & (trim_space(urgency) != ""), legacy_urgency(urgency)).otherwise(own)


def valid_priority(priority: Column) -> Column:
    return priority.isin(*fixed.PRIORITIES)
