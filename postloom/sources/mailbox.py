"""Landed mail files as a Spark data source: ``spark.read.format("mailbox")`` and ``spark.readStream``.

Files stand in ``account_label=<account>/internal_day=<yyyy-mm-dd>/`` below a folder; a name that ends in ``.eml`` is
one message, anything else is an mbox. Large mboxes are split into byte ranges, and a task begins at the first message
that starts in its range, so one account's archive is read by many tasks. Files that end in ``.gz`` are unpacked as they
are read, each from its start: ``write`` packs mail so, in files of a bounded number of messages. Filters on account and
day choose folders before any file is opened (``spark.sql.python.filterPushdown.enabled``). Only Spark plans and runs the scan; a task
reads its ranges through any file system that pyarrow opens by URI.
"""

from __future__ import annotations

import datetime as dt
import gzip
import re
import sys
from collections.abc import Iterator
from contextlib import nullcontext
from dataclasses import dataclass
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan,
                                    GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual)

from postloom.session import settings

SCHEMA = "account_label string, internal_day date, file string, position bigint, raw binary"
# Bytes of a range of a file, and of small files read by one task.
SPLIT_BYTES = 64 << 20
BLOCK = 1 << 20
# Messages of a file that is written: a packed file is read by one task.
FILE_MESSAGES = 1 << 14
PACKED = ".gz"
_FOLDERS = re.compile(r"account_label=([^/]*)/internal_day=(\d{4}-\d{2}-\d{2})/[^/]+$")
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass(frozen=True)
class Piece:
    """A range of a file: messages that start in it are its own."""

    path: str
    account: str
    day: dt.date
    start: int
    end: int


@dataclass
class Pieces(InputPartition):
    pieces: list[Piece]


def numbered_lines(file, start: int) -> Iterator[tuple[int, bytes]]:
    """Lines with their places from ``start`` on; the rest of a line that began before counts as a line."""
    if start:
        file.seek(start)
    rest, at = b"", start
    while block := file.read(BLOCK):
        *lines, rest = (rest + block).split(b"\n")
        for line in lines:
            yield at, line + b"\n"
            at += len(line) + 1
    if rest:
        yield at, rest


def mbox_messages(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Messages whose ``From `` line starts in the range, with its place. That line stands at the start of the file or
    behind a blank line; ``>From `` in a message loses one mark, and the blank line behind it is no part of it."""
    own: list[bytes] | None = None
    place, blank = 0, start == 0

    def message() -> bytes:
        lines = own[:-1] if own and own[-1] in (b"\n", b"\r\n") else own
        return b"".join(line[1:] if re.match(rb">+From ", line) else line for line in lines)

    for at, line in numbered_lines(file, max(0, start - 4)):
        if blank and line.startswith(b"From ") and at >= start:
            if own is not None:
                yield place, message()
                own = None
            if at >= end:
                return
            own, place = [], at
        elif own is not None:
            own.append(line)
        elif at >= end:
            return
        blank = line in (b"\n", b"\r\n") and (at > start - 4 or start <= 4)
    if own is not None:
        yield place, message()


class Folder:
    """The files below a folder, of the accounts and days that filters leave."""

    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        root = options["path"]
        self.root = re.sub(r"^(file:)?/(?=[^/])", "file:///", root)
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.filters: list[Filter] = []

    def keeps(self, account: str, day: dt.date) -> bool:
        values = {("account_label",): account, ("internal_day",): day}
        for f in self.filters:
            value = values[f.attribute]
            if not {EqualTo: lambda: value == f.value, In: lambda: value in f.value,
                    GreaterThan: lambda: value > f.value, GreaterThanOrEqual: lambda: value >= f.value,
                    LessThan: lambda: value < f.value, LessThanOrEqual: lambda: value <= f.value,
                    IsNotNull: lambda: True}[type(f)]():
                return False
        return True

    def files(self) -> Iterator[tuple[Piece, int]]:
        """Each file as a piece, with the time it was written in nanoseconds. Hidden files are left out."""
        system, path = fs.FileSystem.from_uri(self.root)
        for account in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda x: x.path):
            if account.type != fs.FileType.Directory or not account.base_name.startswith("account_label="):
                continue
            for day in sorted(system.get_file_info(fs.FileSelector(account.path)), key=lambda x: x.path):
                named = _FOLDERS.search(f"{day.path}/x")
                if day.type != fs.FileType.Directory or not named:
                    continue
                label, when = unquote(named[1]), dt.date.fromisoformat(named[2])
                if not self.keeps(label, when):
                    continue
                for f in sorted(system.get_file_info(fs.FileSelector(day.path)), key=lambda x: x.path):
                    if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")):
                        yield Piece(f.path, label, when, 0, f.size), f.mtime_ns or 0

    def tasks(self, files: Iterator[Piece]) -> list[Pieces]:
        """Ranges of large files alone, small files of an account and day together."""
        out: list[Pieces] = []
        group, size, key = [], 0, None
        for p in files:
            ranges = [p]
            if not p.path.endswith((".eml", PACKED)) and p.end > self.split:
                ranges = [Piece(p.path, p.account, p.day, at, min(at + self.split, p.end))
                          for at in range(0, p.end, self.split)]
            for piece in ranges:
                if group and ((piece.account, piece.day) != key or size + piece.end - piece.start > self.split):
                    out.append(Pieces(group))
                    group, size = [], 0
                group.append(piece)
                size, key = size + piece.end - piece.start, (piece.account, piece.day)
        return [*out, Pieces(group)] if group else out

    def rows(self, pieces: Pieces) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(self.root)
        for p in pieces.pieces:
            packed = p.path.endswith(PACKED)
            with system.open_input_file(p.path) as stored, gzip.open(stored) if packed else nullcontext(stored) as file:
                if p.path.removesuffix(PACKED).endswith(".eml"):
                    yield p.account, p.day, p.path, 0, file.read()
                else:  # places are those in the mail, which is longer than its packed file
                    for place, raw in mbox_messages(file, p.start, sys.maxsize if packed else p.end):
                        yield p.account, p.day, p.path, place, raw


class MailboxReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = Folder(options)

    def pushFilters(self, filters: list[Filter]):
        ours = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull)
        for f in filters:
            if type(f) in ours and f.attribute in (("account_label",), ("internal_day",)):
                self.folder.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Pieces]:
        return self.folder.tasks(p for p, _ in self.folder.files())

    def read(self, partition: Pieces) -> Iterator[tuple]:
        return self.folder.rows(partition)


class MailboxStream(DataSourceStreamReader):
    """Each file once, in the order in which files were written; a file must appear whole, by a rename."""

    def __init__(self, options: dict[str, str]):
        self.folder = Folder(options)

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        when, path = max(((t, p.path) for p, t in self.folder.files()), default=(-1, ""))
        return {"time": when, "path": path}

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        first, last = (start["time"], start["path"]), (end["time"], end["path"])
        return self.folder.tasks(p for p, t in self.folder.files() if first < (t, p.path) <= last)

    def read(self, partition: Pieces) -> Iterator[tuple]:
        return self.folder.rows(partition)


class Mailbox(DataSource):
    """Options: ``path``; ``splitBytes`` of a range."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MailboxReader:
        return MailboxReader(dict(self.options))

    def streamReader(self, schema) -> MailboxStream:
        return MailboxStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down."""
    spark.dataSource.register(Mailbox)
    spark.conf.set(PUSHDOWN, "true")


def write(mail: DataFrame, folder: str, file_messages: int = FILE_MESSAGES) -> None:
    """Append mail (``account_label, internal_day, raw``, in UTF-8) to packed mbox files, a folder for each account and day.

    A partition of ``mail`` should hold few accounts and days: their files are written side by side, unsorted.
    """
    text = F.regexp_replace(F.col("raw").cast("string"), r"(?m)^(>*From )", ">$1")
    boxed = mail.select("account_label", "internal_day", F.concat(
        F.lit("From postloom\r\n"), text, F.lit("\r\n")).alias("value"))
    boxed = boxed.where(F.col("value").isNotNull())  # a missing mail is no blank line in the one before it
    with settings(mail.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": "64"}):
        boxed.write.mode("append").option("lineSep", "\r\n").option("compression", "gzip").option(
            "zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", file_messages).partitionBy(
            "account_label", "internal_day").text(folder)
