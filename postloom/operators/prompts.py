"""Classification prompts, one per batch of messages, and the user's classifier."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import fixed
from postloom.functions.dates import rfc2822
from postloom.functions.text import label_list
from postloom.operators.ranking import fetch_batches
from postloom.operators.replies import BATCH
from postloom.operators.texts import PLACE, RUN_KEY, Find, with_own_texts, with_texts
from postloom.sources.answers import Calls, ReplyLedger, call_provider

# Batches that share a block of texts, as a power of two.
BATCH_BITS = 6


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


FIELDS = ["account_label", "uid", "from_addr", "subject", "date", "is_read"]


def message_block(body: Column, field: Callable[[str], Column] = F.col) -> Column:
    """One message between its fences; a missing field is empty, the message stays."""
    key = F.concat(_text(field("account_label")), F.lit("/"), _text(field("uid").cast("string")))
    return F.concat(
        F.lit("\n<<< EMAIL "), key, F.lit(" >>>\nFrom: "), _text(field("from_addr")),
        F.lit("\nSubject: "), _text(field("subject")), F.lit("\nDate: "), _text(rfc2822(field("date"))),
        F.lit("\nStatus: "), F.when(field("is_read"), F.lit("Read")).otherwise(F.lit("Unread")),
        F.lit("\n\nBody:\n"), body, F.lit("\n<<< END EMAIL "), key, F.lit(" >>>\n"))


def request_batches(messages: DataFrame, size: int = fixed.FETCH_BATCH) -> DataFrame:
    """Adds ``batch_id``: consecutive messages of one run and account, at most ``size`` each."""
    batched = fetch_batches(messages, size, group=["run_id", "account_label"])
    return batched.withColumn(
        "batch_id", F.concat_ws("/", "account_label", F.col("batch").cast("string"))).drop("batch")


def build_prompts(batched: DataFrame, labels: Sequence[str] = fixed.DEFAULT_LABELS,
                  template: str | None = None, system_prompt: str = "", texts: DataFrame | None = None,
                  parallelism: int | None = None) -> DataFrame:
    """One prompt per batch. A group has at most the batch size in rows.

    Messages hold their ``body``, or with ``texts`` (``body_ref, body``) the columns ``body_ref`` and ``body_nth``. Then
    batches are made of references, and a text goes once to the neighbouring batches that hold it. ``parallelism`` is the
    number of partitions the prompts then come in: references are dealt to them, so that whole prompts need not be.

    Texts that name their message (``run_id, account_label, uid, body_ref, body``) are one for each message, and batches
    are then of ``request_batches``. Such a text is moved once, to the place of its batch; the prompts are made in as many
    partitions as the session shuffles to, of which each of ``parallelism`` tasks reads its share one after the other.

    A ``system_prompt`` goes before the prompt, with a blank line between.

    ``template`` replaces the built-in text; it may hold ``{labels}`` and ``{messages}``, and message
    text is never searched for placeholders.
    """
    names = label_list(labels)
    if template is None:
        head, tail = fixed.PROMPT_HEAD.replace("{labels}", names), fixed.PROMPT_TAIL
        pieces = [head, tail]
    else:
        pieces = [part.replace("{labels}", names) for part in template.split("{messages}")]
    def prompt(blocks: Column) -> Column:
        """The batch as one text, its messages by uid."""
        text = F.array_join(F.transform(blocks, lambda b: b["block"]), "")
        parts: list[Column] = [F.lit(f"{system_prompt}\n\n" if system_prompt else ""), F.lit(pieces[0])]
        for piece in pieces[1:]:
            parts += [text, F.lit(piece)]
        return F.concat(*parts)

    size = F.count(F.lit(1)).alias("n_messages")

    def of_rows(rows: DataFrame, *more: str) -> DataFrame:
        """The prompts of rows that hold their ``body``, grouped by ``more`` as well."""
        block = message_block(F.coalesce("body", F.lit("")))
        blocks = F.sort_array(F.collect_list(F.struct("uid", block.alias("block"))))
        return rows.groupBy(*more, *BATCH).agg(size, blocks.alias("blocks")).select(
            *BATCH, "n_messages", prompt(F.col("blocks")).alias("prompt"))

    if texts is None:
        return of_rows(batched)
    if "uid" in texts.columns:
        named = batched.groupBy(*BATCH).agg(F.collect_list(F.struct(*FIELDS, "body_ref")).alias("messages"))
        tasks = parallelism or 1
        shuffled = int(batched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        made = of_rows(with_own_texts(named, "messages", texts.select(*RUN_KEY, "body_ref", "body"), tasks * -(-shuffled // tasks)), PLACE)
        return made.coalesce(parallelism) if parallelism else made

    def made(batch: Column, find: Find) -> Column:
        blocks = F.sort_array(F.transform(batch["messages"], lambda m: F.struct(m["uid"].alias("uid"), message_block(
            _text(find("bodies", m["body_ref"], m["body_nth"])), lambda name: m[name]).alias("block"))))
        return F.struct(*[batch[c].alias(c) for c in (*BATCH, "n_messages")], prompt(blocks).alias("prompt"))

    batches = batched.groupBy(*BATCH).agg(size, F.collect_list(F.struct(*FIELDS, "body_ref", "body_nth")).alias(
        "messages"), F.min("uid").alias("first_uid"))
    return with_texts(batches, [F.col("run_id"), F.col("first_uid"), F.col("batch_id")],
                      {"bodies": (F.col("messages.body_ref"), texts)}, made, BATCH_BITS, parallelism)


def classify(prompts: DataFrame, provider: Callable[[str], str], attempt: int = 0,
             parallelism: int | None = None, calls: Calls = Calls(), replies: ReplyLedger | None = None) -> DataFrame:
    """Run a user-supplied classifier over prompts: ``prompt -> raw reply``.

    An exception of the provider becomes that batch's ``reply_error``. ``parallelism`` is the number of partitions,
    each of which has as many calls on their way as ``calls`` allows. With ``replies`` each answer is durable as it
    comes, and what was answered before is not asked again.
    """
    if replies is None:
        return call_provider(prompts, provider, attempt, parallelism, calls)
    return replies.answer(prompts, provider, attempt, parallelism, calls)
