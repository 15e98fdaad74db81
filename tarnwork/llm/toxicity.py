"""Toxicity by multiple-instance learning.

Only whole documents have labels. A document is a bag of sentences; each sentence gets a probability from a logistic
model over the distinct words in it, and the document's is their noisy-or, ``1 - prod(1 - p)``: one offending sentence
is enough. The weights are fitted to document labels through the noisy-or, so the model learns which sentences offend,
and can point at them.

The words come from counts over the labelled documents of the fitting sample, made by Spark; the driver gets the
``vocabulary`` most telling words, and for each sampled document the ids of those words by sentence.

Defined results: a null text is scored like an empty one, whose score is that of a single empty sentence; repeated rows
get equal scores; without labels every score is 0; further columns of the input are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwork.llm._common import discard, documents, materialize, table

THRESHOLD = 0.7
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
#: Beginnings of words count too: languages join what offends to other words. Written with a star.
BEGINNINGS = (5, 7)


def features(sentence: str) -> set[str]:
    words = set(WORD.findall(sentence))
    return words.union(*({f"{w[:n]}*" for w in words if len(w) >= n} for n in BEGINNINGS))


def held_out() -> F.col:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


@dataclass(frozen=True)
class SentenceModel:
    """Weights of words, and the bias of a sentence."""

    weights: dict[str, float]
    bias: float

    def sentences(self, text: str) -> Iterator[tuple[int, int, float]]:
        """Start, end and log-odds of each sentence."""
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        for m in SENTENCE.finditer(low):
            words, odds = set(WORD.findall(m[0])), self.bias
            for n, weights in self._by_length:
                found = weights.keys() & ({w[:n] for w in words} if n else words)
                odds += sum(map(weights.__getitem__, found))
            yield m.start(), m.end(), odds

    @cached_property
    def _by_length(self) -> list[tuple[int, dict[str, float]]]:
        whole = {w: x for w, x in self.weights.items() if w[-1] != "*"}
        return [(0, whole), *((n, {w[:-1]: x for w, x in self.weights.items() if w[-1] == "*" and len(w) == n + 1}) for n in BEGINNINGS)]

    def score(self, text: str) -> tuple[float, list[tuple[int, int]]]:
        """The document's probability, and where the sentences lie that alone make it likelier than not."""
        safe, where = -_softplus(self.bias) if not text else 0.0, []
        for start, end, odds in self.sentences(text):
            safe -= _softplus(odds)
            if odds > 0:
                where.append((start, end))
        return -float(np.expm1(safe)), where


def _softplus(x: float) -> float:
    return float(np.logaddexp(0.0, x))


def fit(bags: list[tuple[int, list[list[int]]]], words: list[str], *, rounds: int = 400, rate: float = 0.1, decay: float = 1e-4) -> SentenceModel:
    """Fit to ``(label, word ids by sentence)`` of each document, by gradient steps on the noisy-or's likelihood.

    Sentences without any of the words only add the bias, so they come as a count: an empty list for each.
    """
    labels = np.array([y for y, _ in bags], float)
    counts = np.array([max(1, len(s)) for _, s in bags])
    doc_of, sent_of, word_of = [], [], []
    for doc, (_, sentences) in enumerate(bags):
        for ids in sentences:
            if ids:
                word_of += ids
                sent_of += [len(doc_of)] * len(ids)
                doc_of.append(doc)
    doc_of, sent_of, word_of = (np.array(x, np.int64) for x in (doc_of, sent_of, word_of))
    bare = counts - np.bincount(doc_of, minlength=len(bags))
    theta, m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    theta[-1] = -6.0
    for step in range(1, rounds + 1):
        odds = theta[-1] + np.bincount(sent_of, theta[word_of], minlength=len(doc_of))
        safe = np.bincount(doc_of, np.logaddexp(0, odds), minlength=len(bags)) + bare * np.logaddexp(0, theta[-1])
        any_ = -np.expm1(-safe)
        scale = np.where(labels > 0, -(1 - any_) / np.maximum(any_, 1e-9), 1.0)
        p = 1 / (1 + np.exp(-odds))
        by_sentence = p * scale[doc_of]
        grad = np.zeros_like(theta)
        grad[:-1] = np.bincount(word_of, by_sentence[sent_of], minlength=len(words)) / len(bags) + decay * theta[:-1]
        grad[-1] = (by_sentence.sum() + (bare * scale).sum() / (1 + np.exp(-theta[-1]))) / len(bags)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return SentenceModel({w: float(t) for w, t in zip(words, theta, strict=False) if abs(t) > 1e-6}, float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 12_000, sample_chars: int = 200_000_000, vocabulary: int = 1000, least: int = 5) -> SentenceModel | None:
    """Fit on at most ``sample`` labelled documents that aren't held out, those of smallest hash.

    Args:
        sample: labelled documents for fitting; this bounds what the driver and the broadcast hold.
        sample_chars: characters that these have together, at most; documents beyond them, in the order of the hash,
            aren't used for fitting.
        vocabulary: words that are told apart; ``least``: sampled documents that must hold each.
    """
    picked = labels.where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    labelled = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # At most ``sample`` doc_ids; with each its place in the order of the hash.
    so_far = F.sum("chars").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    sizes = labelled.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.sum(F.length("text").cast("long")).alias("chars"))
    chosen_docs = sizes.withColumn("so_far", so_far).where(F.col("so_far") <= sample_chars).select("doc_id", "toxic")
    chosen_docs = materialize(chosen_docs, "toxicity-chosen")
    bags = materialize(labelled.join(F.broadcast(chosen_docs), "doc_id"), "toxicity-sample")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, text in zip(batch["toxic"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = pa.array(sorted(features(text.lower())), pa.string())
                yield pa.record_batch([found, pa.array([toxic] * len(found), pa.int32())], ["word", "toxic"])

    totals = bags.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    if not totals["n"]:
        discard(chosen_docs, bags)
        return None
    share = (totals["bad"] or 0) / totals["n"]
    counts = bags.select("toxic", "text").mapInArrow(words, "word string, toxic int").groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).where(F.col("n") >= least)
    telling = F.abs(F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * max(share * (1 - share), 1e-9))
    chosen = [r["word"] for r in counts.orderBy(telling.desc(), "word").limit(vocabulary).collect()]
    number = {w: i for i, w in enumerate(chosen)}

    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [[sorted(number[w] for w in number.keys() & features(m[0])) for m in SENTENCE.finditer(text.lower())] for text in batch["text"].to_pylist()]
            yield pa.record_batch([batch["toxic"], pa.array([len(s) for s in ids], pa.int32()), pa.array([[x for x in s if x] for s in ids], pa.list_(pa.list_(pa.int32())))], ["toxic", "n", "ids"])

    found = bags.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(sentences, "toxic int, n int, ids array<array<int>>")
    # At most ``sample`` rows, of ``sample_chars`` characters.
    sampled = found.collect()
    discard(chosen_docs, bags)
    return fit([(r["toxic"], [*r["ids"], *[[]] * (r["n"] - len(r["ids"]))]) for r in sampled], chosen)


def _scored(texts: pa.Array, model: SentenceModel | None) -> Iterator[tuple[float, list[tuple[int, int]]]]:
    """Text by text, so that only one is a Python string at a time."""
    return (model.score(t.as_py() or "") if model else (0.0, []) for t in texts)


def score_documents(docs: DataFrame, model: SentenceModel | None) -> DataFrame:
    """``doc_id, score, offending`` of each row: the sentences ``(start, length)`` that offend, in code points."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scored = list(_scored(batch["text"], model))
            where = pa.array([[{"start": a, "length": b - a} for a, b in w] for _, w in scored], pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))
            yield pa.record_batch([batch["doc_id"], pa.array([s for s, _ in scored], pa.float64()), where], ["doc_id", "score", "offending"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double, offending array<struct<start: int, length: int>>")


def reject_toxic(docs: DataFrame, model: SentenceModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; all columns stay.

    Texts go to Python and scores come back; the other columns stay where they are. Null texts score like empty ones,
    rows of equal texts go or stay together, and an empty table gives no rows.
    """

    def score(texts: pa.Array) -> pa.Array:
        return pa.array((s for s, _ in _scored(texts, model)), pa.float64())

    return docs.where(F.arrow_udf(score, "double")(docs["text"]) < threshold)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``: ``doc_id, held_out, score, predicted``, and the ``offending`` sentences.

    One row for each row of ``documents``; cases are those of the module. Fitted on ``labels`` that aren't held out.
    """
    docs = documents(spark, sf_dir)
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")
