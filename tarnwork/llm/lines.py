"""Line dedup by an exact set-similarity join.

A line is the set of its words, in lower case. A line is removed if an earlier one, by doc_id and line number, has a
Jaccard similarity of at least ``percent``. Lines of equal sets form a class, whose first line stands for it.

Words are ordered by their bytes, the longest first, as these are mostly the rarest, and those of one length by hash.
A line's keys are the pairs of neighbours in that order. A word
that only one of two lines has takes at most two keys from its own line and one from the other, so of n words' keys
all but 2 * (100 - percent) / 100 * n are those of a similar line too; hence similar lines share two of the first keys
of both, which are those of their longest words (prefix filter, on pairs of words). Lengths must also be about the same
(length filter), and each line carries 64 parities of its words' hashes: a word that only one of two lines has changes
at most one of them, so lines with more differing parities than differing words allowed are ruled out without loss.
Below a certain ``percent`` too few pairs of words are sure to be shared, and single words are the keys. The keys of a
class's first line are dealt out once, with its length and parities, to buckets by key. In each bucket a line is
compared with the few before it, which in small buckets are all. In large ones only those for which this finds no match
are then joined with all earlier ones; a pair that shares many of these is made in one of them. Spark can split this join,
and buckets that a sample shows to be huge are dealt out in parts, so no bucket has to fit into one task. Each match is
verified on the whole sets of words, as hashes of 57 bits next to the word's length.

Sets too small to be similar to any other set (at 80 percent, those of up to three words; four words match five) go
through the class step alone.

Defined results: blank lines stay; null texts stay null and empty ones empty; a null doc_id comes before all others;
rows of one doc_id and one text count as one and keep the same lines, those of one doc_id and different texts are
ordered by a hash of the text; a text all of whose lines go becomes empty and its row stays; an empty table gives no
rows; further columns, of any name, are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwork.llm._common import discard, documents, materialize, quoted, small

PERCENT = 80
#: Broadcast at most so many rows of a few numbers.
FEW = 300_000
#: In a bucket, or part of one, each line is first compared with so many before it.
BEFORE = 8
#: Of one in so many lines, more than so many in a bucket have it dealt into parts of about so many lines.
SAMPLE, HUGE, PART = 64, 200, 1000


def _lowered(text: Column) -> Column:
    """In lower case, and with white space but for line feeds as spaces: words are told by one character then, without patterns."""
    text = spaced = F.lower(text)
    for space in "\t\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(space), F.lit(" "))
    return F.when(text.rlike(r"[\t\x0b\f\r]"), spaced).otherwise(text)


def _rank(word: Column) -> Column:
    """A hash of the word, below its negative number of bytes."""
    return F.xxhash64(word).bitwiseAND(F.lit((1 << 57) - 1)).bitwiseOR(F.call_function("shiftleft", (-F.octet_length(word)).cast("long"), F.lit(57)))


def _ranked(line: Column) -> Column:
    """The ranks of the distinct words of a lowered line, the longest word's first."""
    return F.array_remove(F.array_distinct(F.sort_array(F.transform(F.split(line, " "), _rank))), _rank(F.lit("")))


def _parities(ranked: Column) -> Column:
    return F.aggregate(ranked, F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))))


def _keys(percent: int) -> tuple[int, int]:
    """Of how many neighbouring words keys are made, and how many of their first keys similar lines share at least."""
    least = -(-percent // max(1, 100 - percent))  # words of the smallest set that is similar to another one
    pairs = percent >= 60 and all(n - 1 - 2 * n * (100 - percent) // 100 >= 2 for n in range(least, least + 300))
    return (2, 2) if pairs else (1, 1)


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, line_no, line`` with lowered lines; a row of ``docs`` is told by its doc_id and its text's hash."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split(_lowered(F.col("text")), "\n")).alias("line_no", "line"))


def _verified(pairs: DataFrame, firsts: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """``earlier, later`` of the written ``pairs`` of classes ``(a, b)`` whose sets of words have 100 * intersection >= percent * union."""
    ends = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "line-ends")
    needed = materialize(firsts.select("id", "doc_id", "text_key", "line_no").join(small(ends, FEW), "id", "left_semi"), "line-needed")
    texts = materialize(needed.select("doc_id", "text_key").distinct(), "line-docs")
    found = small(texts, FEW)
    there = docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]) & (F.xxhash64(docs["text"]) == found["text_key"]), "left_semi")
    lines, wanted = _lines(there), small(needed, FEW)
    same = lines["doc_id"].eqNullSafe(wanted["doc_id"]) & (lines["text_key"] == wanted["text_key"]) & (lines["line_no"] == wanted["line_no"])
    place = F.struct(lines["doc_id"], lines["text_key"], lines["line_no"])
    sets = materialize(lines.join(wanted, same).select("id", place.alias("place"), _ranked(F.col("line")).alias("words")).dropDuplicates(["id"]), "line-sets")
    both = pairs.join(sets.toDF("a", "place_a", "words_a"), "a").join(sets.toDF("b", "place_b", "words_b"), "b")
    shared, n, m = F.size(F.array_intersect("words_a", "words_b")), F.size("words_a"), F.size("words_b")
    turned = F.col("place_a") > F.col("place_b")
    matches = both.where(100 * shared >= percent * (n + m - shared)).select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("earlier"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("later"))
    matches = materialize(matches, "line-matches")
    discard(ends, needed, texts, sets)
    return matches


def _pairs(later: DataFrame, shared: DataFrame, may_match, least: int) -> DataFrame:
    """``a, b`` for each line of ``later`` and one before it that it shares ``least`` large buckets with.

    A pair that shares many buckets is made once: that of the smallest number makes it.
    """
    fields = ["id", "n", "parities", "large", "no"]
    y, x = (side.select("bucket", *[F.col(f).alias(f"{p}_{f}") for f in fields]) for p, side in (("y", later), ("x", shared)))
    both = F.array_intersect("x_large", "y_large")
    once = (F.size(both) >= least) & (F.array_min(both) == F.col("bucket"))
    made = y.join(x, "bucket").where((F.col("x_no") < F.col("y_no")) & may_match(*[F.col(f"{p}_{f}") for p in "xy" for f in fields[1:3]]) & once)
    return made.select(F.col("x_id").alias("a"), F.col("y_id").alias("b"))


def repeated_lines(docs: DataFrame, *, percent: int = PERCENT, least_words: int = 1) -> DataFrame:
    """``doc_id, text_key, line_no`` of each line of ``docs(doc_id, text)`` that an earlier one matches.

    Args:
        percent: the similarity of matches, at least, in percent.
        least_words: lines with fewer distinct words are left alone; 1 takes every line that has a word.
    """
    docs = docs.select("doc_id", "text")
    together, least_shared = _keys(percent)
    worded = _lines(docs).where(F.length(F.trim("line")) > 0)
    ranked = worded.select("doc_id", "text_key", "line_no", _ranked(F.col("line")).alias("ranked"))
    n = F.size("ranked")
    # All keys but the last of those that a similar line may lack, and one word more for a pair.
    prefix = F.slice("ranked", F.lit(1), F.floor(n * (together * (100 - percent)) / 100 + 1e-9).cast("int") + (least_shared + together - 1))
    able = 100 * n >= percent * (n + 1)  # the nearest other set of n words has one word more
    prefix = F.when(able, prefix)
    lines = ranked.select("doc_id", "text_key", "line_no", n.alias("n"), F.xxhash64("ranked").alias("id"), _parities(F.col("ranked")).alias("parities"), prefix.alias("prefix"))
    lines = materialize(lines.where(F.col("n") >= least_words), "line-prefixes")
    # A class is told by id, n and parities.
    class_ = ["id", "n", "parities"]
    first = lines.groupBy(*class_).agg(F.min(F.struct("doc_id", "text_key", "line_no")).alias("first"), F.count("*").alias("copies"), F.any_value("prefix").alias("prefix"))
    firsts = materialize(first.select(*class_, "copies", "prefix", "first.*"), "line-firsts")
    several = materialize(firsts.where("copies > 1").select(*class_, *[F.col(c).alias(f"first_{c}") for c in ("doc_id", "text_key", "line_no")]), "line-several")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("text_key") == F.col("first_text_key")) & (F.col("line_no") == F.col("first_line_no"))
    copies = materialize(lines.drop("prefix").join(small(several, FEW), class_).where(~is_first).select("doc_id", "text_key", "line_no"), "line-copies")
    discard(lines)

    def may_match(x_n: Column, x_parities: Column, y_n: Column, y_parities: Column) -> Column:
        total = x_n + y_n
        allowed = total - 2 * F.ceil(total * (percent / (100 + percent)) - 1e-9)
        return (F.least(x_n, y_n) * 100 >= F.greatest(x_n, y_n) * percent) & (F.bit_count(x_parities.bitwiseXOR(y_parities)) <= allowed)

    # Flat rows of four numbers, as there is one for each key of a class.
    if together == 2:
        words = firsts.select(*class_, "prefix", F.posexplode("prefix").alias("at", "word"))
        words = words.select(*class_, "word", F.get("prefix", F.col("at") + 1).alias("next")).where("next IS NOT NULL")
        places = words.select(*class_, F.xxhash64("word", "next").alias("bucket"))
    else:
        places = firsts.select(*class_, F.explode("prefix").alias("bucket"))
    # A bucket that a sample shows to be of many thousands of lines is dealt into parts, so that none has to fit into one task.
    huge = places.where(F.pmod("id", F.lit(SAMPLE)) == 0).groupBy("bucket").count().where(F.col("count") > HUGE)
    huge = materialize(huge.select("bucket", F.ceil(F.col("count") * (SAMPLE / PART)).alias("parts")), "line-huge")
    places = places.join(F.broadcast(huge), "bucket", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), "parts"), F.lit(0)))
    # In its bucket, or part of one, each line is compared with the few before it: in small buckets these are all.
    order = Window.partitionBy("bucket", "part").orderBy("id")
    met = places.withColumn("members", F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    met = met.where("members > 1 OR parts IS NOT NULL").withColumn("before", F.collect_list(F.struct(*class_)).over(order.rowsBetween(-BEFORE, -1)))
    like = F.filter("before", lambda x: (x["id"] != F.col("id")) & may_match(x["n"], x["parities"], F.col("n"), F.col("parities")))
    met = met.select("bucket", *class_, ((F.col("members") > BEFORE + 1) | F.col("parts").isNotNull()).alias("many"), F.transform(like, lambda x: x["id"]).alias("like"))
    met = materialize(met.where("many OR size(like) > 0"), "line-met")
    near = met.select(F.explode("like").alias("x"), "id").select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b"))
    near = materialize(near.groupBy("a", "b").agg(F.count("*").alias("keys")), "line-pairs")
    # Keys that a pair shares in small buckets are all counted; any others are in large ones, where both lines are then.
    there = small(materialize(met.where("many").select("id").distinct(), "line-there"), 2_000_000)
    one = near.where(F.col("keys") < least_shared).join(there.toDF("a"), "a", "left_semi").join(there.toDF("b"), "b", "left_semi")
    near = materialize(near.where(F.col("keys") >= least_shared).select("a", "b").union(one.select("a", "b")), "line-near")
    matched = _verified(near, firsts, docs, percent)
    closed = materialize(matched.select(F.col("later").alias("id")).distinct(), "line-closed")

    # In large buckets, those for which this found no match are compared with all earlier ones.
    many = met.where("many").select("bucket", *class_)
    large = many.groupBy("id").agg(F.array_sort(F.collect_set("bucket")).alias("large"))
    large = large.join(firsts.select("id", "doc_id", "text_key", "line_no"), "id").orderBy("doc_id", "text_key", "line_no")
    large = materialize(large.select("id", "large", F.monotonically_increasing_id().alias("no")), "line-large")
    shared = materialize(many.join(large, "id"), "line-buckets")
    later = shared.join(small(closed, 2_000_000), "id", "left_anti")
    rest = materialize(_pairs(later, shared, may_match, least_shared).distinct(), "line-rest")
    discard(shared, met, large)
    more = _verified(rest, firsts, docs, percent)

    gone = materialize(closed.union(more.select("later")).distinct(), "line-gone")
    removed = firsts.join(small(gone, 2_000_000), "id", "left_semi").select("doc_id", "text_key", "line_no").union(copies)
    removed = materialize(removed.distinct(), "line-removed")
    discard(firsts, copies, several, huge, near, matched, closed, rest, more, gone)
    return removed


def _thinned(docs: DataFrame, removed: DataFrame) -> tuple[DataFrame, Column, Column]:
    """``docs`` with its removed lines next to it; the text that is left, and the number of lines that went."""
    by_text = small(materialize(removed.groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("gone")), "line-by-text"), FEW)
    joined = docs.join(by_text, docs["doc_id"].eqNullSafe(by_text["doc_id"]) & (F.xxhash64(docs["text"]) == by_text["text_key"]), "left")
    gone = by_text["gone"]
    left = F.array_join(F.filter(F.split(docs["text"], "\n"), lambda line, i: ~F.array_contains(gone, i)), "\n")
    return joined, F.when(gone.isNull(), docs["text"]).otherwise(left), F.when(gone.isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long")


def remove_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` without the lines ``removed(doc_id, text_key, line_no)``; other columns stay, but ``n_chars`` follows the text."""
    joined, text, _ = _thinned(docs, removed)
    new = {"text": text.alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return joined.select(*[new[c] if c in new else docs[quoted(c)] for c in docs.columns])


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without repeated lines; ``options`` are those of ``repeated_lines``."""
    return remove_lines(docs, repeated_lines(docs, **options))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of each document: ``doc_id, n_lines, n_removed, text_sha256``.

    One row for each row of ``documents``. A null text has no line and counts as empty in the digest; other cases are
    those of the module.
    """
    docs = documents(spark, sf_dir).select("doc_id", "text")
    joined, text, n_removed = _thinned(docs, repeated_lines(docs))
    n_lines = F.when(docs["text"].isNull(), F.lit(0)).otherwise(F.size(F.split(docs["text"], "\n"))).cast("long")
    return joined.select(docs["doc_id"], n_lines.alias("n_lines"), n_removed.alias("n_removed"), F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256).alias("text_sha256"))


#: The rarity order here is by exact counts and then by word, and lines are compared on words: an independent version.
OP7_SQL = r"""
WITH texts AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line FROM texts WHERE text IS NOT NULL),
split AS (
  SELECT doc_id, line_no, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS words
  FROM lines),
worded AS (SELECT doc_id, line_no, words, len(words) AS n FROM split WHERE len(words) > 0),
sets AS (SELECT row_number() OVER (ORDER BY min((doc_id, line_no))) AS no, words, any_value(n) AS n, min((doc_id, line_no)) AS first FROM worded GROUP BY words),
each AS (SELECT no, n, unnest(words) AS w FROM sets),
counts AS (SELECT w, count(*) AS df FROM each GROUP BY w),
ranked AS (SELECT no, n, w, row_number() OVER (PARTITION BY no ORDER BY df, w) AS pos FROM each JOIN counts USING (w)),
prefixes AS (SELECT no, n, w FROM ranked WHERE pos <= n - (n * 80 + 99) // 100 + 1),
pairs AS (
  SELECT DISTINCT x.no AS a, y.no AS b FROM prefixes x JOIN prefixes y ON x.w = y.w AND x.no < y.no
  WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
shared AS (SELECT a, b, len(list_intersect(x.words, y.words)) AS both_, x.n + y.n AS total FROM pairs JOIN sets x ON x.no = a JOIN sets y ON y.no = b),
matched AS (SELECT DISTINCT b AS no FROM shared WHERE 100 * both_ >= 80 * (total - both_)),
removed AS (
  SELECT w.doc_id, w.line_no FROM worded w JOIN sets s ON w.words = s.words
  WHERE (w.doc_id, w.line_no) <> s.first OR s.no IN (SELECT no FROM matched)),
left_ AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.line_no) FILTER (r.doc_id IS NULL) AS text, count(*) AS n_lines, count(r.doc_id) AS n_removed
  FROM lines l LEFT JOIN removed r ON l.doc_id = r.doc_id AND l.line_no = r.line_no GROUP BY l.doc_id)
SELECT t.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(l.text, '')) AS text_sha256
FROM texts t LEFT JOIN left_ l USING (doc_id)
"""
