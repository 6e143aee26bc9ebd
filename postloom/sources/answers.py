"""Replies of the classifier, durable one by one: a call that was answered is not paid for again.

Calls are keyed by the digest of their prompt. A task writes each answer to a file of its own as it comes, so a task
that is lost repeats only what was on its way. ``fold`` moves the small files into a table, which later runs meet by
a join before any call. Speculative tasks would call twice: leave ``spark.speculation`` off for these stages.
"""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom import fixed

BATCH = ["run_id", "batch_id"]
ANSWER = "digest string, raw string"
REPLY = "run_id string, batch_id string, attempt int, raw string, reply_error string"


@dataclass(frozen=True)
class Calls:
    """Bounds of the calls of one partition: how many at once, further tries of one call and of all, seconds for a
    try, and seconds before the first further try (they double)."""

    at_once: int = fixed.LLM_CALLS_AT_ONCE
    retries: int = 2
    retry_budget: int = 100
    timeout: float = fixed.LLM_TIMEOUT_SECONDS
    pause: float = 0.5


class Files:
    """Answers below a folder of any file system that pyarrow opens by URI; used in the tasks."""

    def __init__(self, root: str):
        # a plain path and Hadoop's file:/path name a local folder
        self.root = re.sub(r"^(file:)?/(?=[^/])", "file:///", root)

    def _open(self, digest: str) -> tuple[fs.FileSystem, str]:
        system, path = fs.FileSystem.from_uri(self.root)
        return system, f"{path}/{digest[:2]}/{digest}.json"

    def get(self, digest: str) -> str | None:
        system, path = self._open(digest)
        if system.get_file_info(path).type != fs.FileType.File:
            return None
        with system.open_input_stream(path) as stream:
            return json.loads(stream.read())["raw"]

    def put(self, digest: str, raw: str) -> None:
        system, path = self._open(digest)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        draft = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as stream:
            stream.write(json.dumps({"digest": digest, "raw": raw}).encode() + b"\n")
        system.move(draft, path)


class Caller:
    """The calls of one partition."""

    def __init__(self, provider: Callable[[str], str], files, calls: Calls):
        self.provider, self.files, self.calls = provider, files, calls
        self._left = calls.retry_budget
        self._lock = threading.Lock()

    def _try(self, prompt: str) -> str:
        """One try, given up after its time; the thread of a provider that hangs is left behind."""
        done: Future = Future()

        def run() -> None:
            try:
                done.set_result(self.provider(prompt))
            except BaseException as error:
                done.set_exception(error)

        threading.Thread(target=run, daemon=True).start()
        try:
            return done.result(self.calls.timeout)
        except TimeoutError:
            if done.done():  # the provider's own
                raise
            raise TimeoutError(f"no reply within {self.calls.timeout:g} s") from None

    def _may_retry(self) -> bool:
        with self._lock:
            self._left -= 1
            return self._left >= 0

    def answer(self, digest: str, prompt: str) -> tuple[str | None, str | None]:
        """The reply, or the error of the last try. Only replies are stored: an error is tried again next time."""
        known = self.files.get(digest) if self.files is not None else None
        if known is not None:
            return known, None
        for number in range(self.calls.retries + 1):
            try:
                raw = self._try(prompt)
            except Exception as error:  # a failed call is data, not a failed job
                if number == self.calls.retries or not self._may_retry():
                    return None, str(error)
                time.sleep(self.calls.pause * 2 ** number)
                continue
            if self.files is not None and raw is not None:
                self.files.put(digest, raw)
            return raw, None
        raise AssertionError

    def all(self, prompts: Iterator[tuple[str, str]]) -> Iterator[tuple[str | None, str | None]]:
        """Answers in the order of the prompts, at most so many calls ahead; equal prompts on their way share one."""
        ahead: OrderedDict[int, Future] = OrderedDict()
        by_digest: dict[str, Future] = {}
        with ThreadPoolExecutor(self.calls.at_once) as pool:
            for number, (digest, prompt) in enumerate(prompts):
                if len(ahead) >= 2 * self.calls.at_once:
                    yield ahead.popitem(last=False)[1].result()
                future = by_digest.get(digest)
                if future is None or future.done():
                    future = by_digest[digest] = pool.submit(self.answer, digest, prompt)
                    future.add_done_callback(lambda f, d=digest: by_digest.pop(d, None) if by_digest.get(d) is f else None)
                ahead[number] = future
            while ahead:
                yield ahead.popitem(last=False)[1].result()


def call_provider(prompts: DataFrame, provider: Callable[[str], str], attempt: int = 0, parallelism: int | None = None,
                  calls: Calls = Calls(), files: Files | None = None) -> DataFrame:
    """``run_id, batch_id, attempt, raw, reply_error`` for each of ``prompts``; ``parallelism`` are partitions.

    Equal prompts go to one partition.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller = Caller(provider, files, calls)
        for pdf in batches:
            answers = list(caller.all(zip(pdf["digest"], pdf["prompt"])))
            yield pd.DataFrame({"run_id": pdf["run_id"], "batch_id": pdf["batch_id"], "attempt": attempt,
                                "raw": [a[0] for a in answers], "reply_error": [a[1] for a in answers]})

    source = prompts.select(*BATCH, "prompt", F.sha2("prompt", 256).alias("digest"))
    if parallelism:
        source = source.repartition(parallelism, "digest")
    return source.mapInPandas(run, REPLY)


class ReplyLedger:
    """Answers below ``root``: small files of the runs since the last ``fold`` and a table of the ones before."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.files = Files(f"{self.root}/fresh")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def folded(self) -> DataFrame:
        """The table, each digest once."""
        if not self._fs.exists(self._path("folded")):
            return self.spark.createDataFrame([], ANSWER)
        stored = self.spark.read.schema(ANSWER).parquet(f"{self.root}/folded")
        return stored.groupBy("digest").agg(F.any_value("raw").alias("raw"))

    def fold(self) -> int:
        """Move the small files into the table; returns how many answers. An interrupted fold is finished later; what
        it may add twice is read once."""
        if not self._fs.exists(self._path("fresh")):
            return 0
        name = f"folding-{uuid.uuid4().hex}"
        self._fs.rename(self._path("fresh"), self._path(name))
        return self._take(name)

    def _take(self, name: str) -> int:
        found = self.spark.read.schema(ANSWER).option("recursiveFileLookup", "true").option(
            "pathGlobFilter", "*.json").json(f"{self.root}/{name}")
        count = found.count()
        found.hint("rebalance").write.mode("append").parquet(f"{self.root}/folded")
        self._fs.delete(self._path(name), True)
        return count

    def recover(self) -> int:
        """Finish folds that were interrupted."""
        if not self._fs.exists(self._path("")):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(""))]
        return sum(self._take(n) for n in names if n.startswith("folding-"))

    def answer(self, prompts: DataFrame, provider: Callable[[str], str], attempt: int = 0,
               parallelism: int | None = None, calls: Calls = Calls()) -> DataFrame:
        """Replies to ``prompts``: from the table where it has them, else from the files or by a call."""
        self.recover()
        keyed = prompts.select(*BATCH, "prompt", F.sha2("prompt", 256).alias("digest"))
        folded = self.folded()
        known = keyed.join(folded, "digest").select(
            *BATCH, F.lit(attempt).alias("attempt"), "raw", F.lit(None).cast("string").alias("reply_error"))
        rest = keyed.join(folded.select("digest"), "digest", "left_anti")
        return known.unionByName(call_provider(rest, provider, attempt, parallelism, calls, self.files))
