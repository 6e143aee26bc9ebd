"""Texts by reference: every row and copy as a plain join has them, and no exchange behind the text."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from postloom import catalog
from postloom.operators import messages, prompts
from postloom.operators.texts import join_texts, numbered_refs, with_texts
from postloom.plans.tables import Tables
from postloom.session import stage

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Repeated and missing keys, repeated and missing texts, messages without a text."""
    folder = str(tmp_path_factory.mktemp("odd"))
    at = dt.datetime(2024, 1, 1, 3)
    ids = [*range(0, 60), 7, 7, 23, None, 900]
    events = [(i, at, None if n % 17 == 5 else n % 10, "view", 1.0, '{"k": 40}') for n, i in enumerate(ids)]
    spark.createDataFrame(events, EVENTS).write.parquet(f"{folder}/events.parquet")
    docs = [(i, f"text {i}", "en", "s", 6) for i in (0, 1, 2, 2, 4)] + [(4, "other 4", "en", "s", 7), (5, None, "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        f"{folder}/documents.parquet")
    pages = [(0, "u", "<p>zero</p>"), (1, "u", "<p>one</p>"), (1, "u", "<p>uno</p>")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return Tables(spark, folder)


def listed(df):
    return sorted(map(str, df.collect()))


def exchanged_after(plan, column, behind=0):
    """The most joins and groupings that a column passes behind its scan."""
    children = plan.children()
    kids = [children.apply(i) for i in range(children.size())]
    here = any(step in plan.nodeName() for step in ("Join", "Aggregate", "Window", "Exchange"))
    if not kids:
        return behind if f"{column}#" in plan.simpleString(99) else 0
    return max(exchanged_after(k, column, behind + here) for k in kids)


def plain(t):
    return t.messages.join(t.bodies, messages.KEY, "left")


def test_joined_text_has_the_rows_of_the_view(odd):
    assert listed(odd.messages_with_body.select(*messages.RUN_KEY, "body")) == listed(plain(odd).select(*messages.RUN_KEY, "body"))


def test_text_meets_narrow_rows_last(odd):
    for df in (messages.prompt_inputs(odd.messages_with_body), messages.assemble(odd.headers, odd.known_bodies, odd.texts)):
        assert exchanged_after(df._jdf.queryExecution().sparkPlan(), "text") == 1


def test_assembly_by_reference(odd):
    by_key = messages.assemble(odd.headers, odd.bodies)
    assert listed(messages.assemble(odd.headers, odd.known_bodies, odd.texts)) == listed(by_key)


def test_prompts_by_reference(odd):
    def made(batches):
        return listed(batches.select("run_id", "batch_id", "n_messages", "prompt"))

    rows = prompts.request_batches(plain(odd).where("uid not between 40 and 49"))
    refs = prompts.request_batches(odd.messages_with_ref.where("uid not between 40 and 49"))
    assert made(prompts.build_prompts(refs, texts=odd.texts)) == made(prompts.build_prompts(rows))
    custom = [["A"], "{labels}:{messages}!", "Be brief."]
    assert made(prompts.build_prompts(refs, *custom, texts=odd.texts)) == made(prompts.build_prompts(rows, *custom))


def test_texts_of_many_blocks(spark):
    """More rows than a block has; rows without an id, with an unknown one and with one that has two texts."""
    rows = spark.range(1000).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 7).alias("ref"))
    texts = spark.createDataFrame([(i, f"t{i}") for i in (0, 1, 2, 3, 3, 4)] + [(4, "more")], "ref bigint, text string")
    named = numbered_refs(rows, texts, "ref", "nth", "left")
    got = with_texts(named, [F.col("id")], {"texts": (F.array("ref"), texts)}, lambda r, find: F.struct(
        r["id"].alias("id"), find("texts", r["ref"], r["nth"]).alias("text")), 4)
    assert listed(got) == listed(rows.join(texts, "ref", "left").select("id", "text"))


def test_rows_without_a_reference_spread(spark):
    rows = spark.range(100).select(F.lit("a").alias("account_label"), F.col("id").alias("uid"))
    refs = rows.where("uid < 2").withColumn("body_ref", F.col("uid") + 50)
    texts = spark.createDataFrame([(50, "x"), (51, "y"), (7, "none")], "body_ref bigint, body string")
    got = join_texts(rows, refs, texts)
    assert {(r.uid, r.body) for r in got.where("body is not null").collect()} == {(0, "x"), (1, "y")}
    assert got.count() == 100 and got.columns == ["account_label", "uid", "body"]


def test_raw_mail_has_every_copy(odd):
    """Both texts of a message by reference give as many messages as the joins by key."""
    n = plain(odd).withColumn("page_id", F.floor(F.col("uid") / 40)).join(odd.pages, "page_id", "left").count()
    raw = [r.raw.decode() for r in odd.raw_mail.where("raw is not null").collect()]
    assert odd.raw_mail.count() == n and sum("uno" in r for r in raw) == sum("one" in r for r in raw) > 0


def test_prompts_come_in_the_partitions_asked_for(odd):
    """References are dealt, so no whole prompt has to be."""
    made = prompts.build_prompts(prompts.request_batches(odd.messages_with_ref), texts=odd.texts, parallelism=3)
    assert made.rdd.getNumPartitions() == 3


def test_mail_is_written_without_moving_whole_messages(spark, tmp_path):
    """A message with a missing field is no mail, and leaves no blank line in the one before it."""
    catalog.load()
    at = dt.datetime(2024, 1, 1, 3)
    events = [(i, at, i % 2, None if i % 4 == 1 else "view", 1.0, '{"k": 40}') for i in range(24)]
    spark.createDataFrame(events, EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    docs = [(i, f"text {i}", "en", "s", 6) for i in range(3)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "u", "<p>zero</p>")], "page_id bigint, url string, html string").write.parquet(
        f"{tmp_path}/pages.parquet")
    t = Tables(spark, str(tmp_path))
    sent = t.raw_mail.where("raw is not null").select("uid", F.md5(F.concat(
        F.lit("Message-ID: <"), F.col("uid").cast("string"), F.lit("@postloom>\r\n"), F.col("raw").cast("string"),
        F.lit("\r\n"))).alias("raw_md5"))
    got = catalog.QUERIES["src_06_landed_mailboxes"](t).select("uid", "raw_md5")
    assert listed(got) == listed(sent) and 0 < sent.count() < 24


@pytest.mark.parametrize("parallelism", [None, 3])
def test_own_texts_are_moved_once(spark, parallelism):
    """Keys that repeat or miss, over many places: the prompts are those of rows that hold their text."""
    rng, rows = random.Random(3), []
    for k in range(2000):
        uid = rng.choice([None, rng.randrange(40), rng.randrange(40), rng.randrange(5000), rng.randrange(1 << 32)])
        rows.append((rng.choice(["r1", "r2"]), rng.choice(["a", "b", "b", None]), uid, f"f{k}", "s", None, True,
                     f"text {k}" if k % 9 else None))
    held = stage(spark.createDataFrame(
        rows, "run_id string, account_label string, uid bigint, from_addr string, subject string, date timestamp_ntz, "
        "is_read boolean, body string").withColumn("body_ref", F.monotonically_increasing_id()), "held")
    fresh = held.drop("body").where("uid is null or uid % 7 > 0")
    batched = stage(prompts.request_batches(fresh), "batched")
    own = held.select("run_id", "account_label", "uid", "body_ref", "body")
    made = prompts.build_prompts(batched, texts=own, parallelism=parallelism)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    want = prompts.build_prompts(batched.join(held.select("body_ref", "body"), "body_ref"))
    assert listed(made) == listed(want.select(*made.columns)) and made.count() > 100
    assert parallelism is None or made.rdd.getNumPartitions() == parallelism
    assert prompts.build_prompts(batched.where("false"), texts=own, parallelism=parallelism).count() == 0
