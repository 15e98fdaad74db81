"""Exact duplicates by composable polynomial fingerprints.

The fingerprint of bytes is their value as a number in base 256, modulo a random prime of 127 bits, with their length.
Chunks compose: ``f(a + b) = f(a) * 256 ** len(b) + f(b)``. Texts beyond ``huge`` bytes are cut into chunks that become
rows, are hashed wherever Spark puts them, and are combined per text; shorter ones are hashed chunk by chunk where they
lie. Only texts whose fingerprints repeat are then compared, exactly: their chunks stream through an aggregation by
fingerprint and chunk number that keeps the smallest and the largest chunk, so even a hot text needs two chunks of
memory and is combined before the shuffle. A fingerprint whose chunks differ is split by SHA-256.

Before all that, each run of white space (space, tab to carriage return) becomes one space.

Defined results: a null text counts as empty; repeated rows are copies of each other (the rows of the smallest doc_id
stay, which are several if doc_ids repeat); rows without a doc_id only stay if no copy has one, and then have no
keep_id; an empty table gives no rows; further columns of the input are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm._common import discard, documents, materialize, slices, small

#: A prime, drawn once at random.
MODULUS = 0x5A3C8F0E96D1B47A2C7E61F3B80D9513
CHUNK = 1 << 16
SPACES = b" \t\n\x0b\x0c\r"


def _is_prime(n: int) -> bool:
    return all(pow(a, n - 1, n) == 1 for a in (2, 3, 5, 7, 11, 13, 17))


while not _is_prime(MODULUS):
    MODULUS += 2


def polynomial(data: bytes) -> int:
    return int.from_bytes(data, "big") % MODULUS


def combine(parts: Iterable[tuple[int, int]]) -> tuple[int, int]:
    """The length and hash of a whole from those of its parts, in order."""
    length, value = 0, 0
    for n, h in parts:
        length, value = length + n, (value * pow(256, n, MODULUS) + h) % MODULUS
    return length, value


def single_spaced(data: bytes, before: bytes = b"") -> bytes:
    """``data`` with one space for each run of white space; none for a run that has begun in ``before``."""
    out = b" ".join(data.split())
    if data[:1] and data[:1] in SPACES and not (before and before[-1:] in SPACES):
        out = b" " + out
    return out + b" " if out.strip(b" ") and data[-1:] in SPACES else out


def _chunks(data: bytes) -> Iterator[bytes]:
    return (data[i : i + CHUNK] for i in range(0, len(data), CHUNK))


def _key(length: int, value: int) -> str:
    return f"{length:x}-{value:032x}"


def fingerprints(docs: DataFrame, huge: int = 1 << 23) -> DataFrame:
    """``doc_id, text_key, fingerprint, text_sha256`` of every row of ``docs(doc_id, text)``; ``text_key`` is a hash of the text as it is."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"))
    names = ["doc_id", "text_key", "fingerprint", "text_sha256"]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, shas = [], []
            for text in batch["text"]:
                data = single_spaced(text.as_buffer().to_pybytes())
                keys.append(_key(*combine((len(c), polynomial(c)) for c in _chunks(data))))
                shas.append(hashlib.sha256(data).hexdigest())
            yield pa.record_batch([batch["doc_id"], batch["text_key"], pa.array(keys, pa.string()), pa.array(shas, pa.string())], names)

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = [(len(d), polynomial(d)) for d in (single_spaced(c.as_py(), b.as_py()) for c, b in zip(batch["chunk"], batch["before"], strict=True))]
            columns = [pa.array([n for n, _ in hashed], pa.int64()), pa.array([f"{h:032x}" for _, h in hashed], pa.string())]
            yield pa.record_batch([*[batch[c] for c in of_row], batch["at"], *columns], [*of_row, "at", "n", "h"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_key(*combine((p["n"], int(p["h"], 16)) for p in parts)) for parts in batch["parts"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], batch["text_key"], pa.array(keys, pa.string()), batch["text_sha256"]], names)

    out, of_row = "doc_id long, text_key long, fingerprint string, text_sha256 string", ["row", "doc_id", "text_key", "text_sha256"]
    is_huge = F.octet_length("text") > huge
    data = F.encode("text", "UTF-8")
    sha = F.sha2(F.encode(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "), "UTF-8"), 256)
    starts = F.sequence(F.lit(0), F.octet_length("text") - 1, F.lit(CHUNK))
    cut = (
        rows.where(is_huge)
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_key", sha.alias("text_sha256"), data.alias("data"), starts.alias("starts"))
        .select(*of_row, "data", F.explode("starts").alias("at"))
        .select(*of_row, "at", F.substring("data", F.col("at") + 1, F.lit(CHUNK)).alias("chunk"), F.when(F.col("at") > 0, F.substring("data", F.col("at"), F.lit(1))).otherwise(F.lit(b"")).alias("before"))
    )
    hashed = cut.repartition("row", "at").mapInArrow(chunk, "row long, doc_id long, text_key long, text_sha256 string, at int, n long, h string")
    # A row for each chunk of one text: at most 32,768 short ones, since a string has 2 GB at most.
    parts = hashed.groupBy(*of_row).agg(F.array_sort(F.collect_list(F.struct("at", "n", "h"))).alias("parts"))
    return rows.where(~is_huge).mapInArrow(short, out).union(parts.mapInArrow(whole, out))


def _chunk_rows(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """``fingerprint, at, chunk``: the chunks of the normalised texts of ``needed(doc_id, text_key, fingerprint)``."""
    text = F.coalesce(docs["text"], F.lit(""))
    found = docs.join(needed, docs["doc_id"].eqNullSafe(needed["doc_id"]) & (F.xxhash64(text) == needed["text_key"]))
    data = F.encode(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), "UTF-8")
    cut = found.select("fingerprint", data.alias("data"))
    cut = cut.select("fingerprint", "data", F.explode(F.sequence(F.lit(0), F.greatest(F.octet_length("data") - 1, F.lit(0)), F.lit(CHUNK))).alias("at"))
    return cut.select("fingerprint", "at", F.substring("data", F.col("at") + 1, F.lit(CHUNK)).alias("chunk"))


def mark_duplicates(docs: DataFrame, *, huge: int = 1 << 23, broadcast_rows: int = 200_000) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Args:
        huge: bytes beyond which a text is hashed as many rows.
        broadcast_rows: repeated fingerprints that are broadcast at most; more are joined by a shuffle.
    """
    prints = materialize(fingerprints(docs, huge), "exact-prints")
    repeated = materialize(prints.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"), "exact-repeated")
    needed = prints.join(small(repeated, broadcast_rows), "fingerprint", "left_semi").select("doc_id", "text_key", "fingerprint").distinct()
    needed = materialize(needed, "exact-needed")
    compared = _chunk_rows(docs, small(needed, broadcast_rows)).groupBy("fingerprint", "at").agg((F.min("chunk") != F.max("chunk")).alias("differs"))
    unequal = materialize(compared.where("differs").select("fingerprint").distinct(), "exact-unequal")
    discard(repeated, needed)
    told = prints.join(small(unequal.withColumn("split", F.lit(True)), broadcast_rows), "fingerprint", "left")
    keyed = told.withColumn("key", F.when(F.col("split"), F.concat_ws("/", "fingerprint", "text_sha256")).otherwise(F.col("fingerprint")))
    groups = keyed.groupBy("key").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = small(materialize(groups, "exact-groups"), broadcast_rows)
    keep = F.coalesce("keep_id", "doc_id")
    return keyed.join(groups, "key", "left").select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def op5_polynomial_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates among all ``documents``; columns are those of ``mark_duplicates``, cases those of the module."""
    return mark_duplicates(documents(spark, sf_dir))


OP5_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
FROM t
"""
