"""Calls of the classifier: bounds, retries, and answers that outlive tasks."""

import os
import threading
import time

import pytest

from postloom.operators import prompts
from postloom.sources.answers import Caller, Calls, Files, ReplyLedger

PROMPT = "run_id string, batch_id string, prompt string"


def answers(provider, texts, files=None, **bounds):
    caller = Caller(provider, files, Calls(**{"pause": 0.0, **bounds}))
    return list(caller.all((t, t) for t in texts))


def test_order_and_bound():
    lock, now, most = threading.Lock(), [0], [0]

    def slow(text):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02 if int(text) % 3 else 0.05)
        with lock:
            now[0] -= 1
        return text * 2

    texts = [str(k) for k in range(40)]
    start = time.time()
    assert answers(slow, texts, at_once=4) == [(t * 2, None) for t in texts]
    assert 2 <= most[0] <= 4 and time.time() - start < 1.0


def test_retries_and_budget():
    seen = {}

    def flaky(text):
        seen[text] = seen.get(text, 0) + 1
        if text == "bad" or seen[text] < 3:
            raise RuntimeError(f"no {text} {seen[text]}")
        return "ok"

    assert answers(flaky, ["a", "bad", "b"], at_once=1) == [("ok", None), (None, "no bad 3"), ("ok", None)]
    assert seen == {"a": 3, "bad": 3, "b": 3}
    seen.clear()
    got = answers(flaky, [f"x{k}" for k in range(5)], at_once=1, retry_budget=5)
    assert [a[0] for a in got] == ["ok", "ok", None, None, None] and sum(seen.values()) == 5 + 5


def test_timeout():
    def hang(text):
        if text == "hang":
            time.sleep(30)
        return "ok"

    start = time.time()
    assert answers(hang, ["hang", "b"], timeout=0.1, retries=0) == [(None, "no reply within 0.1 s"), ("ok", None)]
    assert time.time() - start < 5

    def own(text):
        raise TimeoutError("its own")

    assert answers(own, ["a"], retries=0) == [(None, "its own")]


def test_equal_prompts_share_a_call(tmp_path):
    calls = []

    def provider(text):
        calls.append(text)
        time.sleep(0.02)
        return text.upper()

    assert answers(provider, ["a"] * 6 + ["b"] + ["a"] * 6, Files(str(tmp_path)), at_once=3) == [
        ("A", None)] * 6 + [("B", None)] + [("A", None)] * 6
    assert sorted(calls) == ["a", "b"]


def test_files(tmp_path):
    for root in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        assert Files(root).root == f"file://{tmp_path}"
    files = Files(f"file:{tmp_path}/x")
    assert files.get("abc") is None
    files.put("abc", 'tëxt "\n')
    assert files.get("abc") == 'tëxt "\n'


def counting(folder, crash_at=None):
    """A provider that notes each call in a folder, and may kill its worker."""

    def provider(prompt):
        import os
        import uuid
        if prompt == crash_at and not os.path.exists(f"{folder}/crashed"):
            open(f"{folder}/crashed", "w").close()
            time.sleep(0.5)  # the calls before are answered meanwhile
            os._exit(1)
        open(f"{folder}/{prompt}-{uuid.uuid4().hex}", "w").close()
        return f"reply to {prompt}"

    return provider


def called(folder):
    return sorted(n.split("-")[0] for n in os.listdir(folder) if n != "crashed")


def test_lost_task_repeats_no_answered_call(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    book = ReplyLedger(spark, f"{tmp_path}/replies")
    made = spark.createDataFrame([("r", f"b{k}", f"p{k}") for k in range(20)], PROMPT).coalesce(1)
    with pytest.raises(Exception):
        prompts.classify(made, counting(notes, "p13"), parallelism=1, replies=book).collect()
    before = called(notes)
    assert before
    for _ in range(2):
        got = {r.batch_id: r.raw for r in prompts.classify(made, counting(notes, "p13"), parallelism=2, replies=book).collect()}
        assert got == {f"b{k}": f"reply to p{k}" for k in range(20)}
    assert called(notes) == sorted(f"p{k}" for k in range(20))  # each call once


def test_folded_answers_are_met_by_a_join(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    book = ReplyLedger(spark, f"{tmp_path}/replies")
    assert book.fold() == 0 and book.recover() == 0

    def ask(texts):
        made = spark.createDataFrame([("r", f"b{k}", t) for k, t in enumerate(texts)], PROMPT)
        return sorted(r.raw for r in prompts.classify(made, counting(notes), 1, replies=book).collect())

    ask(["x", "y"])
    assert book.fold() == 2 and not os.path.exists(f"{tmp_path}/replies/fresh")
    assert ask(["x", "y", "z", "z"]) == ["reply to x", "reply to y", "reply to z", "reply to z"]
    os.rename(f"{tmp_path}/replies/fresh", f"{tmp_path}/replies/folding-1")  # a fold that stopped half way
    assert ask(["x", "z"]) == ["reply to x", "reply to z"]
    assert called(notes) == ["x", "y", "z"] and book.folded().count() == 3


def test_errors_are_tried_again(spark, tmp_path):
    book = ReplyLedger(spark, f"{tmp_path}/replies")
    made = spark.createDataFrame([("r", "b", "p")], PROMPT)

    def down(prompt):
        raise RuntimeError("down")

    bounds = Calls(retries=0)
    first = prompts.classify(made, down, calls=bounds, replies=book).first()
    assert (first.raw, first.reply_error) == (None, "down")
    assert prompts.classify(made, lambda p: "up", calls=bounds, replies=book).first().raw == "up"
