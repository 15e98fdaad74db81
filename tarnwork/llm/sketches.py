"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the sorted array of the ``SIZE`` smallest 64-bit hashes of a text's distinct shingles (fewer if the text
has fewer). Sketches of parts merge into the sketch of the whole, and give estimates of resemblance, of containment
and of the number of distinct shingles; they are exact for texts whose sketches aren't full. All of it is built from
Spark's functions.

Words are what lies between white space (space, tab to carriage return), A to Z in lower case; a shingle is five words.
A text with fewer is one shingle of all its words; without words it has none.

Defined results: a null text has the sketch of an empty one, which resembles empty sketches alone; rows that repeat a
doc_id follow each other in the order of a hash of their texts; rows without doc_id come last; an empty table gives no
rows; further columns of the input are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwork.llm._common import SPACE_CLASS, ascii_lower, documents, materialize, sha256_hex, small

SIZE = 128
WORDS = 5


def word_hashes(text: Column) -> Column:
    """The hashes of a text's words, in order."""
    words = F.filter(F.split(ascii_lower(text), f"{SPACE_CLASS}+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def sketch_of(hashes: Column, words: int = WORDS, size: int = SIZE) -> Column:
    """The sketch from a column of word hashes. Give a column of a table, not an expression: each shingle reads it."""
    n = F.size(hashes)
    run = F.transform(F.sequence(F.lit(1), n - words + 1), lambda i: F.xxhash64(*[F.get(hashes, i + (j - 1)) for j in range(words)]))
    short = F.when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))
    return F.slice(F.sort_array(F.array_distinct(F.when(n >= words, run).otherwise(short))), 1, size)


def merge(a: Column, b: Column, size: int = SIZE) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """The estimated Jaccard similarity, from 0 to 1; that of two empty sketches is 1."""
    least = merge(a, b, size)
    shared = F.size(F.array_intersect(least, F.array_intersect(a, b)))
    return F.when(F.size(least) == 0, F.lit(1.0)).otherwise(shared / F.size(least))


def distinct_count(a: Column, size: int = SIZE) -> Column:
    """The estimated number of distinct shingles."""
    share = F.element_at(a, size) / F.lit(2.0**64) + 0.5
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) / share)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """The estimated share of a's shingles that b has, from 0 to 1; that of an empty a is 1."""
    both = resemblance(a, b, size) * distinct_count(merge(a, b, size), size)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_count(a, size)))


def merge_parts(parts: DataFrame, keys: list[str], sketch: str = "sketch", size: int = SIZE) -> DataFrame:
    """Merge the sketches of each group of rows; only the smallest hashes of each task are shuffled."""
    hashes = parts.select(*keys, F.explode(sketch).alias("_hash")).distinct()
    ranked = hashes.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))).where(F.col("_at") <= size)
    merged = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list("_hash")).alias(sketch))
    same = [F.col(f"_all.{k}").eqNullSafe(F.col(f"_merged.{k}")) for k in keys]
    all_keys = parts.select(*keys).distinct().alias("_all")
    return all_keys.join(merged.alias("_merged"), same, "left").select("_all.*", F.coalesce(f"_merged.{sketch}", F.array().cast("array<bigint>")).alias(sketch))


def written(sketch: Column) -> Column:
    """16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def _next_cells(cells: DataFrame, bits: int, few: int) -> DataFrame:
    """``cell, next_cell``: for each number of the distinct ``cells(cell)`` the next smaller one, null for the smallest.

    A window holds at most ``2 ** bits`` cells of one parent; what follows a parent's last cell is found among parents.
    """
    down = F.col("cell").desc()
    if cells.limit(few + 1).count() <= few:
        return cells.select("cell", F.lead("cell").over(Window.partitionBy(F.lit(0)).orderBy(down)).alias("next_cell"))
    parent = F.shiftright("cell", bits)
    heads = materialize(cells.groupBy(parent.alias("parent")).agg(F.max("cell").alias("head")), "sketch-heads")
    follow = _next_cells(heads.select(F.col("parent").alias("cell")), bits, few).toDF("parent", "next_parent")
    heads = follow.join(heads.toDF("next_parent", "next_head"), "next_parent", "left").select("parent", "next_head")
    within = cells.select("cell", parent.alias("parent"), F.lead("cell").over(Window.partitionBy(parent).orderBy(down)).alias("next_cell"))
    return materialize(within.join(heads, "parent").select("cell", F.coalesce("next_cell", "next_head").alias("next_cell")), "sketch-cells")


def with_next(docs: DataFrame, *, bits: int = 9, few: int = 4096) -> DataFrame:
    """Each row of ``docs(doc_id, text)`` with the row of the next smaller doc_id; after the last comes the first.

    Rows meet in cells of ``2 ** bits`` neighbouring doc_ids, so a cell has no more of them than that. The row that
    follows a cell's last is sent to two cells. Returns ``cell, rank, doc_id, text, next_text``, and ``guest`` for rows
    that are only there for the one before them; ``(cell, guest, rank)`` orders them.
    """
    lowest = F.lit(-(1 << 63)).cast("long")
    place = F.coalesce("doc_id", lowest)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    heads = materialize(rows.groupBy(F.shiftright(place, bits).alias("cell")).agg(F.max(place).alias("head")), "sketch-first")
    follow = materialize(_next_cells(heads.select("cell"), bits, few), "sketch-next")
    first = follow.agg(F.max("cell").alias("first"))
    follow = follow.crossJoin(F.broadcast(first)).select("cell", F.coalesce("next_cell", "first").alias("next_cell"))
    # The first row of a cell is a guest in the cell before.
    guests = follow.join(heads.toDF("next_cell", "head"), "next_cell").select("head", F.col("cell").alias("host"))
    guests = small(materialize(guests, "sketch-guests"), 500_000)
    own = F.struct(F.shiftright(place, bits).alias("cell"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("host").alias("cell"), F.lit(True).alias("guest"))
    seats = F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, guest))
    seated = rows.join(guests, place == F.col("head"), "left").select("doc_id", "text", F.explode(seats).alias("seat"))
    seated = seated.select("seat.*", "doc_id", F.struct(F.bitwise_not(place).alias("down"), F.xxhash64("text").alias("tie")).alias("rank"), "text")
    order = Window.partitionBy("cell").orderBy("guest", "rank")
    return seated.withColumn("next_text", F.coalesce(F.lead("text").over(order), F.lit("")))


def fingerprint_edits(docs: DataFrame, *, size: int = SIZE) -> DataFrame:
    """Fingerprint each text of ``docs(doc_id, text)`` and an edited one, whose second half begins the next text."""
    paired = with_next(docs).withColumn("n_chars", F.length("text"))
    half = F.shiftright("n_chars", 1)
    edited = F.concat(F.left("text", F.col("n_chars") - half), F.left(F.col("next_text"), half))
    words = paired.select("cell", "guest", "rank", "doc_id", "n_chars", sha256_hex(edited).alias("edited_sha256"), word_hashes(F.col("text")).alias("own"), word_hashes(edited).alias("other"))
    prints = words.select("cell", "guest", "rank", "doc_id", "n_chars", "edited_sha256", sketch_of(F.col("own"), size=size).alias("sketch"), sketch_of(F.col("other"), size=size).alias("edited"))
    follow = F.lead("sketch").over(Window.partitionBy("cell").orderBy("guest", "rank"))
    told = prints.withColumn("following", follow).where(~F.col("guest"))
    return told.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        written(F.col("sketch")).alias("fingerprint"),
        written(F.col("edited")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited"), size).alias("near_edited"),
        resemblance(F.col("sketch"), F.coalesce("following", "sketch"), size).alias("near_next"),
    )


def op1_bottom_k_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir))
