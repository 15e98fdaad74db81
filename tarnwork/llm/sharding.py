"""Minimax contiguous partition of ordered atomic groups into shards.

Documents with equal texts form one atomic group. Groups are ordered by the SHA-256 of their text, the smallest
shard capacity for which a greedy left-to-right fill needs no more than the wanted shards is found by binary search,
and the order is cut there. The search runs on prefix sums: the driver keeps a bounded sample of them, decides each
greedy check with lower and upper bounds, and asks Spark only for the stretches that are still undecided, so it holds
``sample`` numbers whatever the size of the corpus.

Defined results: a null text counts as 0 bytes and forms a group apart from the empty text; rows that repeat stay
separate rows of one group; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwork.llm._common import documents, materialize

SHARDS = 24
ROW_OVERHEAD = 8


class Prefixes:
    """A growing sample of a sorted set of prefix sums, with bounds on the sums between its members.

    ``fetch(spans, buckets)`` returns for half-open spans ``(lo, hi]`` the largest sum of each of ``buckets`` equal
    steps and the number of sums in it. Gaps known to hold no further sums are remembered as closed.
    """

    def __init__(self, total: int, fetch, sample: int = 20_000):
        self.total, self.fetch, self.sample = total, fetch, sample
        self.known = [0, total]
        self.open = {0} if total > 1 else set()

    def floor(self, t: int) -> tuple[int, int]:
        """Bounds of the largest sum that is at most ``t``."""
        i = bisect_right(self.known, t) - 1
        low = self.known[i]
        return low, (min(t, self.known[i + 1] - 1) if low in self.open else low)

    def ceil(self, t: int) -> tuple[int, int]:
        """Bounds of the smallest sum that is at least ``t``."""
        i = bisect_left(self.known, t)
        high = self.known[i]
        return (max(t, self.known[i - 1] + 1) if i and self.known[i - 1] in self.open else high), high

    def refine(self, points: list[int]) -> None:
        """Ask for the sums in the open gaps around ``points``."""
        gaps = sorted({self.known[bisect_right(self.known, min(p, self.total)) - 1] for p in points} & self.open)
        spans = [(g, self.known[bisect_right(self.known, g)]) for g in gaps]
        if not spans:
            return
        steps = max(2, self.sample // len(spans))
        found = self.fetch(spans, steps)
        for lo, hi in spans:
            self.open.discard(lo)
            edges = [lo]
            for value, count in sorted(found.get(lo, [])):
                if count > 1:
                    self.open.add(edges[-1])
                if value != edges[-1]:
                    edges.append(value)
            if edges[-1] != hi:
                edges.append(hi)
        self.known = sorted({*self.known, *(v for values in found.values() for v, _ in values)})
        self.open = {g for g in self.open if self.known[bisect_right(self.known, g)] - g > 1}


def _forward(p: Prefixes, capacity: int, shards: int, upper: bool) -> list[int]:
    at, path = 0, []
    for _ in range(shards):
        at = p.floor(at + capacity)[upper] if at + capacity < p.total else p.total
        path.append(at)
    return path


def _backward(p: Prefixes, capacity: int, shards: int, lower: bool) -> list[int]:
    at, path = p.total, []
    for _ in range(shards):
        at = p.ceil(at - capacity)[0 if lower else 1] if at > capacity else 0
        path.append(at)
    return path


def smallest_capacity(p: Prefixes, shards: int) -> int:
    """The smallest capacity with which a greedy fill places everything in ``shards`` shards."""

    def first(good, lo: int, hi: int) -> int:
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if good(mid) else (mid + 1, hi)
        return lo

    while True:
        sure = first(lambda c: _forward(p, c, shards, False)[-1] == p.total, 0, p.total)
        maybe = first(lambda c: _forward(p, c, shards, True)[-1] == p.total, 0, sure)
        if sure == maybe:
            return sure
        p.refine([*_forward(p, maybe, shards, False), *_forward(p, maybe, shards, True), *_forward(p, sure, shards, True)])


def even_cuts(p: Prefixes, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and cuts within it that come as near to equal shards as the groups allow.

    A greedy fill to the brim leaves the last shards short, so each cut is the known prefix sum nearest to an equal
    share of what is left, between the earliest cut from which the rest still fits and the latest within capacity.
    """
    capacity = smallest_capacity(p, shards)
    while _backward(p, capacity, shards, True) != (earliest := _backward(p, capacity, shards, False)):
        p.refine([x - 1 for path in (earliest, _backward(p, capacity, shards, True)) for x in path if x > 0])
    earliest = earliest[::-1]  # earliest[k]: smallest end of the first k shards
    cuts, at = [], 0
    for k in range(1, shards):
        target, low, high = at + (p.total - at) // (shards - k + 1), max(earliest[k], at), min(at + capacity, p.total)
        p.refine([target])
        i = bisect_left(p.known, target)
        near = [v for v in (*p.known[max(0, i - 1) : i + 1], earliest[k]) if low <= v <= high]
        at = min(near, key=lambda v: (abs(v - target), v)) if near else at
        cuts.append(at)
    return capacity, cuts


def shard_documents(docs: DataFrame, shards: int = SHARDS, *, buckets: int = 4096, cells: int = 128, sample: int = 20_000) -> DataFrame:
    """Place every row of ``docs(doc_id, text)`` in a shard; see the module's docstring for the method.

    Args:
        buckets: ranges of the group order within which prefix sums are taken in parallel.
        cells: parts of each shard within which rows are numbered in parallel.
        sample: prefix sums that the driver asks for at once.

    Returns ``doc_id, size, text_crc32, shard, slot``: equal texts share a shard and ``slot`` has no gaps from 0.
    """
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = materialize(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
            F.crc32(data).alias("text_crc32"),
            F.coalesce(F.sha2(F.encode("text", "UTF-8"), 256), F.lit("-")).alias("_key"),
        ),
        "shard-rows",
    )
    bucket = F.pmod(F.coalesce(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"), F.lit(0)) * buckets / F.lit(1 << 32), F.lit(buckets)).cast("int")
    groups = rows.groupBy(bucket.alias("_bucket"), "_key").agg(F.sum("size").alias("_bytes"))
    sums = groups.withColumn("_within", F.sum("_bytes").over(Window.partitionBy("_bucket").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)))
    sums = materialize(sums.select("_bucket", "_key", "_within"), "shard-sums")
    # At most ``buckets`` rows, however large the corpus.
    tops = sorted(sums.groupBy("_bucket").agg(F.max("_within")).collect())
    starts, total = {}, 0
    for b, top in tops:
        starts[b], total = total, total + top
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0)
    spark: SparkSession = docs.sparkSession
    offsets = spark.createDataFrame([(b, s) for b, s in starts.items()], "_bucket int, _start long")
    ends = sums.join(F.broadcast(offsets), "_bucket").select("_key", (F.col("_start") + F.col("_within")).alias("_end"))

    def fetch(spans: list[tuple[int, int]], steps: int) -> dict[int, list[tuple[int, int]]]:
        span = spark.createDataFrame(spans, "_lo long, _hi long")
        step = F.floor((F.col("_end") - F.col("_lo") - 1) / F.ceil((F.col("_hi") - F.col("_lo")) / steps))
        inside = ends.join(F.broadcast(span), (F.col("_end") > F.col("_lo")) & (F.col("_end") <= F.col("_hi")))
        out: dict[int, list[tuple[int, int]]] = {}
        for lo, _, end, count in inside.groupBy("_lo", step.alias("_step")).agg(F.max("_end"), F.count("*")).collect():
            out.setdefault(lo, []).append((end, count))
        return out

    _, cuts = even_cuts(Prefixes(total, fetch, sample), shards)
    last = dict(ends.where(F.col("_end").isin(sorted({c for c in cuts if c}))).select("_end", "_key").collect())
    shard = sum((F.lit(0) if not c else (F.col("_key") > F.lit(last[c])).cast("int") + 0 for c in cuts), F.lit(sum(not c for c in cuts)))
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("_cell", F.pmod(F.xxhash64("doc_id"), F.lit(cells)).cast("int"))
    # shards * cells rows: a constant.
    per_cell = placed.groupBy("shard", "_cell").agg(F.count("*").alias("_n"))
    before = per_cell.select("shard", "_cell", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_cell")) - F.col("_n")).alias("_before"))
    numbered = placed.withColumn("_at", F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("doc_id", "_key")))
    return numbered.join(F.broadcast(before), ["shard", "_cell"]).select("doc_id", "size", "text_crc32", "shard", (F.col("_before") + F.col("_at") - 1).cast("long").alias("slot"))


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
