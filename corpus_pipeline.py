"""The corpus pipeline: toxicity, line dedup, near-duplicate removal, secret scans, packing.

All stages but the last give the columns of their input, whatever these are called. In each of them null texts stay
null and count as empty, rows that repeat a doc_id and a text are treated alike, rows without a doc_id are decided like
others, very long texts are read whole, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnwork.llm import lines, minhash, packing, secrets, toxicity
from tarnwork.llm._common import discard, documents, materialize, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; rows of equal texts go or stay together. Without labels none goes."""
    return toxicity.reject_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go, and ``n_chars`` follows.

    The earlier of two equal lines is that of the smaller doc_id (none is smallest). A text that loses all its lines
    stays as an empty row.
    """
    return lines.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, a similarity of 0.8 or more.

    That of the smallest doc_id stays. Texts without words are linked with nothing and stay.
    """
    return minhash.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and ``n_chars`` follows; no row goes."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of cost-balanced sequences; each row is packed, a null text as its closing id alone."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("packing", pack),
]

#: SQL can't express the fitted model nor the packing; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all ``documents``; each stage before it is written, and removed once it is read."""
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
