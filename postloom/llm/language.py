"""Language ID by error-correcting output codes over hashed byte n-grams.

Each bit of a language's codeword is predicted by a binary naive Bayes classifier; decoding takes the
codeword of least weighted loss and flags a narrow win. Null text and text without a letter are
``und`` with score 0. Without any labelled row everything is ``und``. Repeated rows get equal results; a row
without an id is no part of the sample and is predicted as any other. Of languages of equal loss the first by name
is taken. Long texts are read whole, in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import packed, unpacked

BUCKETS = 1 << 15
GRAMS = (1, 2, 3, 4)
PIECE = 1 << 16
# Bound of the labelled sample: so many rows of each language, those with the smallest hashed ids.
PER_LANGUAGE = 600
# A document is ambiguous when the best two languages are closer than this.
MARGIN = 0.2
SHARPNESS = 40.0

_LETTERS_ONLY = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, in pieces of bounded size."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace").translate(_LETTERS_ONLY), dtype=np.uint8)
    for start in range(0, len(raw), PIECE):
        part = raw[max(0, start - max(GRAMS) + 1):start + PIECE].astype(np.uint32)
        skip = 0 if start == 0 else max(GRAMS) - 1
        for n in GRAMS:
            own = part[max(0, skip - n + 1):]
            if len(own) < n:
                continue
            value = np.full(len(own) - n + 1, n, dtype=np.uint32)
            for k in range(n):
                value = (value * np.uint32(0x01000193)) ^ own[k:len(own) - n + 1 + k]
            value *= np.uint32(0x9E3779B1)
            yield value >> np.uint32(32 - BUCKETS.bit_length() + 1)


def codewords(classes: int) -> np.ndarray:
    """One row of +1/-1 per class: exhaustive codes up to seven classes, spread random codes above."""
    if classes <= 1:
        return np.ones((classes, 1), dtype=np.int8)
    if classes <= 7:
        columns = [[1 if c == 0 or not (k >> (c - 1)) & 1 else -1 for c in range(classes)]
                   for k in range(1, 2 ** (classes - 1))]
        return np.array(columns, dtype=np.int8).T
    bits, best = int(np.ceil(12 * np.log2(classes))), None
    for seed in range(20):
        code = np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.int8), (classes, bits))
        apart = (bits - code.astype(int) @ code.T.astype(int) + 2 * bits * np.eye(classes, dtype=int)).min()
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


@dataclass
class Model:
    """Languages, their codewords, a weight per n-gram bucket and bit, and a trust per bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        """Mean log odds of each code bit."""
        total, n = np.zeros(self.code.shape[1]), 0
        for buckets in grams(text):
            total += self.weights[buckets].sum(0)
            n += len(buckets)
        return total / max(n, 1) - self.bias

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous) of least trust-weighted logistic loss."""
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        z = self.code * (self.margins(text) * SHARPNESS)
        loss = (np.logaddexp(0.0, -z) * self.trust).sum(1) / self.trust.sum()
        odds = np.exp(loss.min() - loss)
        odds /= odds.sum()
        order = np.argsort(-odds, kind="stable")
        second = odds[order[1]] if len(order) > 1 else 0.0
        return self.languages[order[0]], float(odds[order[0]]), bool(odds[order[0]] - second < MARGIN)


def fold(docs: DataFrame):
    """Remainder of the hashed id by five; null for a null id."""
    return F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")) % 5


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """At most ``per_language`` labelled documents of each language, none of fold 0; whole texts.

    Ids are counted per language first; a hash threshold then leaves about twice as many as wanted, and only those are
    ranked by their hash. So the task that ranks a language gets a bounded number of rows, however many there
    are. Of several rows with one id and language the least text counts.
    """
    labelled = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text").where(
        (fold(docs) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    hashed = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 31) - 1))
    # One row a language; the rows left are bounded in number, and go to the texts.
    near = labelled.select("doc_id", "lang").join(F.broadcast(counts), "lang").where(
        hashed * F.col("n").cast("double") <= F.lit(float(2 * per_language << 31))).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = near.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= per_language).drop("_at")
    found = labelled.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")
    return found.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")


def _bucket_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, rows in batch.groupby("lang"):
            counts = np.zeros(BUCKETS, dtype=np.int64)
            for text in rows["text"]:
                for buckets in grams(text):
                    counts += np.bincount(buckets, minlength=BUCKETS)
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": counts[at]})


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Count n-grams of the sample per language in Spark; the model has a bounded size.

    A bit trusts its classifier by the log odds of its accuracy on the sample.
    """
    rows = sample(docs, per_language)
    counted = rows.mapInPandas(_bucket_counts, "lang string, bucket int, n bigint").groupBy(
        "lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    if not languages:
        return Model([], codewords(0), np.zeros((BUCKETS, 1)), np.zeros(1), np.ones(1))
    at = {lang: k for k, lang in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS))
    counts[counted["lang"].map(at), counted["bucket"]] = counted["n"]
    share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    code = codewords(len(languages))
    weights = np.zeros((BUCKETS, code.shape[1]), dtype=np.float32)
    for bit in range(code.shape[1]):
        yes, no = share[code[:, bit] > 0], share[code[:, bit] < 0]
        if len(yes) and len(no):
            weights[:, bit] = np.log(yes.mean(0)) - np.log(no.mean(0))
    # The threshold of a bit lies midway between the nearest languages of its two sides.
    centre = share @ weights
    bias = np.array([(c[s > 0].min() + c[s < 0].max()) / 2 if (s < 0).any() else 0.0
                     for c, s in zip(centre.T, code.T)])
    model = Model(languages, code, weights, bias, np.ones(code.shape[1]))

    def bits_right(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            right = np.array([model.margins(t) * code[at[lang]] > 0
                              for lang, t in zip(batch["lang"], batch["text"])], dtype=np.int64)
            yield pd.DataFrame({"bit": np.arange(code.shape[1]),
                                "n": right.reshape(-1, code.shape[1]).sum(0), "of": len(batch)})

    right = rows.mapInPandas(bits_right, "bit int, n bigint, of bigint").groupBy("bit").agg(
        F.sum("n").alias("n"), F.sum("of").alias("of")).toPandas().sort_values("bit")
    accuracy = ((right["n"] + 1) / (right["of"] + 2)).to_numpy()
    model.trust = np.maximum(np.log(accuracy / (1 - accuracy)), 0.05)
    return model


def predictor(model: Model):
    """Arrow-batched column function: text to struct(lang_pred, score, ambiguous)."""

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.decode(t) for t in texts],
                               columns=["lang_pred", "score", "ambiguous"])

    return predict


def predict_languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous."""
    model = train(docs) if model is None else model
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = own.select("doc_id", F.coalesce(fold(own) == 0, F.lit(False)).alias("held_out"),
                     predictor(model)("text").alias("p"))
    return out.select("doc_id", "held_out", "p.*")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents in a language the model knows; ``und`` goes, ambiguous documents stay."""
    rows = packed(docs).withColumn("_lang", predictor(train(docs))("text")["lang_pred"])
    return unpacked(rows.where("_lang <> 'und'"))
