"""Query catalog: one entry per operator, with its oracle statement where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from postloom.plans.tables import Tables, oracle

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is the oracle over base tables and views."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return wrap


def load() -> None:
    """Import every module that registers queries."""
    from postloom.catalog import (digests, messages, replies, sinks, statistics,  # noqa: F401
                                  streams, text)
