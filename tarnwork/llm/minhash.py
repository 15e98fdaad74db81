"""Near duplicates by circulant MinHash.

Two permutations give a whole signature. The first scatters a text's shingles over a circle of ``CIRCLE`` places; the
second gives each place a value. Coordinate k of the signature is the smallest value among the places k steps on, that
is, under the second permutation shifted circularly by k. Bands of the signature are the buckets in which candidates
meet; each link is confirmed by the exact Jaccard similarity of the two whole sets of shingles (as 64-bit hashes).
Shingles that share a place only bring sets closer, so huge sets give more candidates, never fewer.

Texts with equal sets form a class, of which one member is compared. Within a bucket not all pairs are formed: first
each class is compared with the bucket's most central member, the one that meets most others in all buckets, and
components are made of the links; then, in further rounds, with a member picked by a hash, if that is in another
component. At last only classes that are still apart from the most central member are compared with those of other
components in the bucket, so no link between components is lost, however large a bucket is. No pair is confirmed twice.

Three filters keep pairs from being formed. Two are exact: sizes, and ``PARITIES`` parities of the shingles' hashes, of
which a shingle that only one of two sets has changes one, so sets with more differing parities than a link allows
differing shingles can't be linked. The third leaves out pairs whose signatures differ in so many lowest bits that a
link has a probability of less than 1e-9. 73 bands of 7 rows miss a pair of similarity 0.8 with a probability of 4e-8.

Words are what lies between white space (space, tab to carriage return), A to Z in lower case. A text with fewer words
than a shingle has is one shingle; without words it has none and is linked with nothing. Null texts count as empty.
Rows of equal texts are copies of each other, also if they repeat a doc_id. A component is named by its smallest
doc_id; rows without a doc_id are linked like others, and their component has no name only if none of it has a
doc_id, so that all of it stays. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm._common import discard, documents, materialize, slices, small
from tarnwork.llm.components import connected_components

CIRCLE = 1 << 22
BANDS, ROWS = 73, 7
#: Coordinates of a signature: those of the bands, and one to fill the last word of lowest bits.
SIZE = 512
PARITIES = 1024
SEED = 20_260_101


def shingle_hashes(texts: pa.StringArray, words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    coded = lists.flatten().dictionary_encode()
    of_word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(coded.dictionary))
    hashes, at = of_word[coded.indices.to_numpy()], lists.offsets.to_numpy()
    at = at - at[0]
    empty = pc.equal(pc.binary_length(pc.ascii_trim_whitespace(texts)), 0).to_numpy(zero_copy_only=False)

    def chained(parts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(parts[0]), np.uint64)
        for p in parts:
            out = (out ^ p) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    n = len(hashes) - words + 1
    runs = chained([hashes[i : i + n] for i in range(words)]) if n > 0 else hashes[:0]
    out = []
    for i in range(len(texts)):
        a, b = at[i], at[i + 1]
        if empty[i]:
            out.append(hashes[:0])
        elif b - a < words:
            out.append(chained([hashes[j : j + 1] for j in range(a, b)]) ^ np.uint64(b - a))
        else:
            out.append(np.unique(runs[a : b - words + 1]))
    return out


class Circulant:
    def __init__(self, bands: int = BANDS, rows: int = ROWS, size: int = SIZE):
        rng = np.random.default_rng(SEED)
        self.bands, self.rows = bands, rows
        # An odd factor permutes the 64-bit hashes; the upper bits of the product are the place.
        self.factor = rng.integers(1, 1 << 62, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = np.uint64(65 - CIRCLE.bit_length())
        # Permuted where it lies, as 32-bit numbers: a worker never holds a second copy.
        values = np.arange(CIRCLE + size, dtype=np.int32)
        rng.shuffle(values[:CIRCLE])
        values[CIRCLE:] = values[:size]
        # Row i: the values of the places i, i + 1, ...: what the shifts of the second permutation make of place i.
        self.shifted = np.lib.stride_tricks.sliding_window_view(values, size)
        self.factors = rng.integers(1, 1 << 62, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = rng.integers(1, 1 << 62, bands, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = ((shingles * self.factor) >> self.shift).astype(np.int64)
        least = self.shifted[places[:1024]].min(axis=0)
        for i in range(1024, len(places), 1024):
            np.minimum(least, self.shifted[places[i : i + 1024]].min(axis=0), out=least)
        return least

    def keys(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit key for each band; the lowest bits of all coordinates and the shingles' parities, in words of 64."""
        signature = self.signature(shingles)
        banded = signature[: self.bands * self.rows].astype(np.uint64).reshape(self.bands, self.rows)
        mixed = (banded * self.factors).sum(axis=1, dtype=np.uint64) ^ self.salts
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        parities = np.bincount((shingles & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
        return (mixed ^ (mixed >> np.uint64(29))).view(np.int64), np.packbits(np.concatenate([signature & 1, parities])).view(np.int64)


@lru_cache(maxsize=1)
def circulant() -> Circulant:
    """Kept from task to task."""
    return Circulant()


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """``row, doc_id, text_key, n_shingles, set_key, bands, bits`` of each row of ``docs(doc_id, text)``.

    ``set_key`` tells sets apart, ``bands`` has a key for each band, ``bits`` what ``Circulant.keys`` gives; a row is
    told by ``doc_id`` and ``text_key``, or by ``row`` once the result is written.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in slices(batches):
            sets = shingle_hashes(part["text"], words)
            keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
            signed = [circulant().keys(s) if len(s) else (None, None) for s in sets]
            bands, bits = (pa.array([x[i] for x in signed], pa.list_(pa.int64())) for i in (0, 1))
            yield pa.record_batch([part["doc_id"], part["text_key"], pa.array([len(s) for s in sets], pa.int64()), keys, bands, bits], ["doc_id", "text_key", "n_shingles", "set_key", "bands", "bits"])

    signed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(sign, "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>, bits array<long>")
    return signed.select(F.monotonically_increasing_id().alias("row"), "*")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs of ``classes`` ``(a, b)`` whose whole sets have 100 * intersection >= percent * union."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                left, a_at = np.unique(part["a"].to_numpy(), return_index=True)
                known = dict(zip(left.tolist(), shingle_hashes(part["text_a"].take(pa.array(a_at)), words), strict=True))
                links = []
                for a, b, other in zip(part["a"].to_pylist(), part["b"].to_pylist(), shingle_hashes(part["text_b"], words), strict=True):
                    both = len(np.intersect1d(known[a], other, assume_unique=True))
                    if 100 * both >= percent * (len(known[a]) + len(other) - both):
                        links.append((a, b))
                yield pa.record_batch([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ends = materialize(ends, "minhash-ends")
    needed = materialize(classes.select("node", "doc_id", "text_key").join(small(ends, 200_000), "node", "left_semi"), "minhash-needed")
    wanted = small(needed, 200_000)
    same = docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (F.xxhash64(docs["text"]) == wanted["text_key"])
    texts = materialize(docs.join(wanted, same).select("node", "text").dropDuplicates(["node"]), "minhash-texts")
    joined = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    links = materialize(joined.mapInArrow(confirm, "a long, b long"), "minhash-links")
    discard(ends, needed, texts)
    return links


def compared(docs: DataFrame, *, words: int = 5, percent: int = 80, rounds: int = 3) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id`` of each row of ``docs(doc_id, text)``; see ``near_duplicates``."""
    docs = docs.select("doc_id", "text")
    rows = materialize(signatures(docs, words), "minhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.col("row").alias("node"), "text_key", "n_shingles", "bands", "bits"))
    classes = rows.where("n_shingles > 0").groupBy("set_key").agg(first.alias("first"), F.count("*").alias("copies"))
    classes = materialize(classes.select("set_key", "copies", "first.*"), "minhash-classes")
    places = classes.select("node", F.explode("bands").alias("band"))
    shared = places.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(places.join(shared, "band"), "minhash-shared")
    weights = met.groupBy("node").agg(F.sum("n").alias("weight"))
    member = F.struct("node", "n_shingles", "bits", "weight").alias("x")
    places = materialize(met.select("band", "node").join(weights.join(classes.select("node", "n_shingles", "bits"), "node"), "node").select("band", member), "minhash-buckets")
    discard(met)

    alike, bit_words = percent / 100, SIZE // 64
    # Lowest bits differ with a probability of (1 - similarity) / 2: allow six standard deviations more.
    bits = int(SIZE * (1 - alike) / 2 + 6 * (SIZE * (1 - alike**2) / 4) ** 0.5)

    def may_link(x: Column, y: Column) -> Column:
        n, m = x["n_shingles"], y["n_shingles"]
        differing = lambda words: reduce(lambda a, b: a + b, (F.bit_count(x["bits"][i].bitwiseXOR(y["bits"][i])) for i in words))
        sizes = F.least(n, m) * 100 >= F.greatest(n, m) * percent
        # A link has 100 * (union - differing) >= percent * union, and n + m = 2 * union - differing.
        parities = differing(range(bit_words, bit_words + PARITIES // 64)) * (100 + percent) <= (n + m) * (100 - percent)
        return sizes & parities & (differing(range(bit_words)) <= bits)

    tried: list[DataFrame] = []

    def linked(pairs: DataFrame) -> DataFrame:
        ordered = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        for before in tried:
            ordered = ordered.join(before, ["a", "b"], "left_anti")
        tried.append(materialize(ordered, "minhash-pairs"))
        return confirmed(tried[-1], classes, docs, words, percent)

    central = F.struct(F.col("x.weight"), -F.col("x.node"))

    def placed(found: DataFrame) -> DataFrame:
        """The places with their components, and the component of the bucket's most central member."""
        of = places.join(found.select(F.col("node").alias("of"), "component"), F.col("x.node") == F.col("of"), "left").select("band", "x", F.coalesce("component", "x.node").alias("component"))
        lead = of.groupBy("band").agg(F.max_by("component", central).alias("lead"))
        return materialize(of.join(lead, "band"), "minhash-placed")

    def stars(members: DataFrame, choice: Column) -> DataFrame:
        """Each member of a bucket with the one of highest ``choice``, where their components differ."""
        pivots = members.groupBy("band").agg(F.max_by(F.struct("x", "component"), choice).alias("p")).select("band", F.col("p.x").alias("y"), F.col("p.component").alias("c"))
        return members.join(pivots, "band").where((F.col("component") != F.col("c")) & may_link(F.col("x"), F.col("y")))

    def joined(links: DataFrame, found: DataFrame | None) -> DataFrame:
        """Components of further links; those so far stand as links to their smallest members."""
        out = connected_components(links if found is None else links.union(found.select("node", "component")), "minhash")
        discard(links, *([] if found is None else [found]))
        return out

    found = joined(linked(stars(places.withColumn("component", F.col("x.node")), central)), None)
    for k in range(rounds):
        known = placed(found)
        found = joined(linked(stars(known, F.xxhash64("band", "x.node", F.lit(k)))), found)
        discard(known)
    placed_ = placed(found)
    known = placed_.withColumn("apart", F.col("component") != F.col("lead"))
    apart = known.where("apart").select("band", "x", F.col("component").alias("c"))
    others = known.select("band", F.col("x").alias("y"), "component", F.col("apart").alias("too"))
    # Of two classes that are both apart, each pair once.
    once = ~F.col("too") | (F.col("x.node") < F.col("y.node"))
    rest = apart.join(others, (apart["band"] == others["band"]) & (F.col("c") != F.col("component")) & once & may_link(F.col("x"), F.col("y")))
    found = joined(linked(rest), found)

    names = classes.select("set_key", "copies", "node", F.col("doc_id").alias("first_id")).join(found.select("node", "component"), "node", "left")
    of_component = names.where("component IS NOT NULL").groupBy("component").agg(F.min("first_id").alias("name"))
    same = names.where("copies > 1 OR component IS NOT NULL").join(of_component, "component", "left")
    same = same.select("set_key", F.when(F.col("component").isNull(), F.col("first_id")).otherwise(F.col("name")).alias("component_id"), F.lit(True).alias("several"))
    told = rows.select("doc_id", "text_key", "n_shingles", "set_key").join(small(materialize(same, "minhash-same"), 200_000), "set_key", "left")
    discard(placed_, places, classes, found, *tried)
    return told.select("doc_id", "text_key", "n_shingles", F.when(F.col("several"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, rounds: int = 3) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id, kept``.

    Args:
        words: words of a shingle.
        percent: the similarity of linked texts, at least, in percent.
        rounds: how often members are compared with one picked by hash, before the exact rest.
    """
    told = compared(docs, words=words, percent=percent, rounds=rounds)
    return told.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest doc_id; all columns stay, whatever their names.

    Rows that repeat a doc_id and a text count as one document, and stay or go together. Of a group whose rows all
    lack a doc_id, all stay.
    """
    told = compared(docs, words=words, percent=percent)
    gone = small(materialize(told.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_key").distinct(), "minhash-dropped"), 1_000_000)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]) & F.xxhash64(docs["text"]).eqNullSafe(gone["text_key"]), "left_anti")


def op3_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all ``documents`` on two-word shingles; columns and cases are those of ``near_duplicates``."""
    return near_duplicates(documents(spark, sf_dir), words=2)


#: Candidates are the pairs that share a rare shingle (the prefix filter of set joins), which loses no link.
OP3_SQL = r"""
WITH RECURSIVE
texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 2 THEN words
    ELSE list_sort(list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) END AS shingles
  FROM texts),
classes AS MATERIALIZED (SELECT min(doc_id) AS no, shingles, len(shingles) AS n FROM sets WHERE len(shingles) > 0 GROUP BY shingles),
each AS (SELECT no, n, unnest(shingles) AS s FROM classes),
counts AS (SELECT s, count(*) AS df FROM each GROUP BY s),
ranked AS (SELECT no, n, s, row_number() OVER (PARTITION BY no ORDER BY df, s) AS pos FROM each JOIN counts USING (s) ),
prefixes AS MATERIALIZED (SELECT no, n, s FROM ranked WHERE pos <= n - (n * 80 + 99) // 100 + 1),
pairs AS (
  SELECT DISTINCT x.no AS a, y.no AS b FROM prefixes x JOIN prefixes y ON x.s = y.s AND x.no < y.no
  WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT a, b, len(list_intersect(x.shingles, y.shingles)) AS both_, x.n + y.n AS total FROM pairs JOIN classes x ON x.no = a JOIN classes y ON y.no = b)
  WHERE 100 * both_ >= 80 * (total - both_)),
near AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT no, no FROM classes),
reached AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reached r JOIN near n ON r.b = n.a),
components AS (SELECT a AS no, min(b) AS component_id FROM reached GROUP BY a)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, s.doc_id = coalesce(component_id, s.doc_id) AS kept
FROM sets s LEFT JOIN classes c ON s.shingles = c.shingles LEFT JOIN components USING (no)
"""
