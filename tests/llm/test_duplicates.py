"""Exact, near and line duplicates, sketches and shards against brute force."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from tarnwork.llm import components, exact, lines, minhash, sharding, sketches


def _classes(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 101 + i) for i in range(20)] + [(5, 5)]
    found = components.connected_components(spark.createDataFrame(pairs, "a long, b long"))
    nodes = {x for p in pairs for x in p}
    assert {r.node: r.component for r in found.collect()} == _classes(pairs, nodes)


def test_near_duplicates(docs, texts, none):
    sets = {}
    for i, text in texts:
        words = text.encode().lower().split()
        sets[i] = set(zip(words, words[1:], strict=False)) if len(words) > 1 else {tuple(words)} if words else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    found = minhash.near_duplicates(docs, words=2).collect()
    assert len(found) == len(texts)
    assert {r.doc_id: r.component_id for r in found} == _classes(links, sets)
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in found)
    assert minhash.near_duplicates(none, words=2).count() == 0


def test_exact_duplicates_also_of_huge_texts(docs, texts, none):
    groups = defaultdict(list)
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    for i, text in texts:
        groups[normal(text)].append(i)
    expected = sorted((i, min(groups[normal(t)]), len(groups[normal(t)]), i == min(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in texts)
    assert sorted(map(tuple, exact.mark_duplicates(docs).collect())) == expected
    chunk, exact.CHUNK = exact.CHUNK, 7
    try:
        assert sorted(map(tuple, exact.mark_duplicates(docs.where("doc_id > 900000 AND doc_id <> 900007"), huge=9).collect())) == sorted(e for e in expected if e[0] > 900_000 and e[0] != 900_007)
    finally:
        exact.CHUNK = chunk
    assert exact.mark_duplicates(none).count() == 0


def test_fingerprints_compose():
    data = bytes(range(256)) * 50
    whole = exact.combine([(len(data), exact.polynomial(data))])
    for step in (1, 7, 1000):
        assert exact.combine((len(c), exact.polynomial(c)) for c in (data[i : i + step] for i in range(0, len(data), step))) == whole
    text = b"  a\t\tb \n c  "
    for cut in range(len(text) + 1):
        assert exact.single_spaced(text[:cut]) + exact.single_spaced(text[cut:], text[:cut]) == re.sub(rb"[\x20\x09-\x0D]+", b" ", text)


def test_equal_fingerprints_of_different_texts_are_told_apart(docs, texts, monkeypatch):
    monkeypatch.setattr(exact, "_key", lambda length, value: "same")
    few = docs.where("doc_id >= 900001")
    found = {(r.doc_id, r.keep_id, r.group_size) for r in exact.mark_duplicates(few).collect()}
    assert (900_005, 900_005, 2) not in found and (900_003, 900_003, 1) in found and (900_001, 900_001, 2) in found


def _matched_lines(texts, least_words=1):
    """Every line against every earlier one, whatever words they share."""
    expected, seen, known = set(), [], set()
    for i, text in sorted(dict(texts).items()):
        for k, line in enumerate(text.split("\n")):
            words = frozenset(line.encode().lower().split())
            if len(words) < max(1, least_words):
                continue
            n = len(words)
            if words in known or any(4 * n <= 5 * len(o) <= 6.25 * n + 5 and 100 * len(words & o) >= 80 * len(words | o) for o in seen):
                expected.add((i, k))
            if words not in known:
                known.add(words)
                seen.append(words)
    return expected


def test_lines_that_an_earlier_one_matches(spark, docs, texts, none):
    added = [(950_001, "Les.\na b\n\n \na b c d"), (950_002, "les.\nb a\n\n \na b c\nd c b a e"), (950_003, "Les. Les.\na b c x\na b")]
    few = docs.select("doc_id", "text").where("length(text) < 3000 OR text IS NULL").union(spark.createDataFrame(added, "doc_id long, text string"))
    given = {r.doc_id: r.text or "" for r in few.collect()}
    for least in (1, 5):
        expected = _matched_lines(given, least)
        removed = lines.repeated_lines(few, least_words=least)
        assert {(r.doc_id, r.line_no) for r in removed.collect()} == expected and removed.count() == len(expected)
        left = lines.remove_lines(few, removed)
        assert left.columns == few.columns and left.count() == few.count()
        told = {r.doc_id: r.text for r in left.collect()}
        assert all((told[i] or "") == "\n".join(line for k, line in enumerate(t.split("\n")) if (i, k) not in expected) for i, t in given.items())
    assert lines.dedup_lines(none).count() == 0
    assert {(950_002, 0), (950_002, 1), (950_002, 5), (950_003, 0), (950_003, 2)} <= _matched_lines(given)


def test_lines_of_rows_without_or_with_one_doc_id(spark):
    rows = [(None, "same short line\nq w e r t y", "n"), (7, "same short line\na b c d e f", "x"), (7, "m n o p q r s\na b c d e f", "y"), (7, "m n o p q r s\na b c d e f", "y")]
    columns = "doc_id long, text string, _id string"
    docs = spark.createDataFrame(rows, columns).withColumns({c: F.lit(c) for c in ("gone", "text_key", "_gone", "no", "key", "a.b")})
    left = lines.dedup_lines(docs)
    assert left.columns == docs.columns
    told = sorted((r["_id"], r["text"]) for r in left.collect())
    assert told[0] == ("n", "same short line\nq w e r t y") and len(told) == 4
    assert "m n o p q r s" in told[2][1] and told[2] == told[3]  # never lost with the other text of its doc_id
    assert (told[1][1], told[2][1]) in {("", "m n o p q r s\na b c d e f"), ("a b c d e f", "m n o p q r s")}


def test_random_lines_hardly_meet_and_matches_are_found_at_any_bound(spark, monkeypatch):
    """Lines that share single words only don't reach the join; near copies of them are found by pairs of words or, at low bounds, by words."""
    rng, met, written = random.Random(5), [], lines.materialize
    rows = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(30))) for i in range(600)]

    def counted(df, name):
        table = written(df, name)
        if name == "line-buckets":
            met.append(table.count())
        return table

    monkeypatch.setattr(lines, "materialize", counted)
    assert lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    assert met[0] < 300
    near = []
    for i in range(120):
        words = rows[rng.randrange(12)][1].split()[: rng.randrange(4, 30)]
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(5000)}"
        near.append((1000 + i, "\t ".join(words)))
    for percent in (60, 80):
        sets = [(i, frozenset(t.split())) for i, t in rows[:12] + near]
        expected = {i for k, (i, x) in enumerate(sets) if any(100 * len(x & y) >= percent * len(x | y) for _, y in sets[:k])}
        found = lines.repeated_lines(spark.createDataFrame(rows[:12] + near, "doc_id long, text string"), percent=percent)
        assert {r.doc_id for r in found.collect()} == expected and expected


def test_lines_of_small_buckets_are_compared_without_a_join(spark, monkeypatch):
    """Pairs of near copies are found as their keys are dealt out; only lines of large buckets go on to be joined."""
    rng, met, written = random.Random(6), [], lines.materialize
    rows = [(2 * i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))) for i in range(60)]
    rows += [(i + 1, text.rsplit(" ", 1)[0] + f" other{i}") for i, text in rows]

    def counted(df, name):
        table = written(df, name)
        if name == "line-buckets":
            met.append(table.count())
        return table

    monkeypatch.setattr(lines, "materialize", counted)
    for huge in (lines.HUGE, -1):
        monkeypatch.setattr(lines, "HUGE", huge)
        found = lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {(r.doc_id, r.line_no) for r in found.collect()} == {(2 * i + 1, 0) for i in range(60)}
    assert met[0] == 0


def test_lines_that_share_many_buckets_make_a_pair_once(spark, monkeypatch):
    """A group of lines that differ a little too much or just little enough."""
    rng, made, pairs = random.Random(8), [], lines._pairs
    base = [f"word{i}" for i in range(45)]
    rows = []
    for i in range(80):
        words = list(base)
        for at in rng.sample(range(45), rng.randrange(2, 8)):
            words[at] = f"other{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))

    def counted(*args):
        found = pairs(*args)
        made.append((found.count(), found.select("a", "b").distinct().count()))
        return found

    monkeypatch.setattr(lines, "_pairs", counted)
    found = lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.line_no) for r in found.collect()} == _matched_lines(rows)
    assert 0 < made[0][0] < 2 * made[0][1]


def test_large_groups_of_near_copies_in_full(spark):
    """A third of the rows are near copies of one text, with similarities around the bound; also rows without ids."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 14)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i if i % 50 else None, " ".join(words)))
    rows += [(1000 + i, " ".join(f"r{rng.randrange(5000)}" for _ in range(60))) for i in range(150)] + [(5000, None), (5001, ""), (1000, None)]
    sets = [set(zip(t.split(), t.split()[1:], strict=False)) if t else set() for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    classes = _classes(links, range(len(rows)))
    members = defaultdict(list)
    for k, c in classes.items():
        members[c].append(rows[k][0])
    name = {c: min((i for i in ids if i is not None), default=None) for c, ids in members.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash.near_duplicates(docs, words=2).collect()
    expected = sorted(((rows[k][0], len(sets[k]), name[c]) for k, c in classes.items()), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    clashing = docs.withColumns({c: F.lit(1) for c in ("node", "text_key", "component_id", "kept", "a.b")})
    left = minhash.drop_near_duplicates(clashing, words=2)
    assert left.columns == clashing.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((rows[k][0] for k, c in classes.items() if rows[k][0] == name[c]), key=str)


def test_sketches_and_edits(docs, texts, none):
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def chained(parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64(p, seed=seed).intdigest()
        return signed(seed)

    def sketch(text):
        words = [struct.pack("<q", chained([w])) for w in text.encode().lower().split()]
        runs = [words[i : i + 5] for i in range(len(words) - 4)] or ([words] if words else [])
        return sorted({chained(r) for r in runs})[:128]

    hexed = lambda s: "".join(f"{h & (2**64 - 1):016X}" for h in s)
    one = docs.dropDuplicates(["doc_id"])
    order = sorted(dict(texts).items(), reverse=True)
    found = {r.doc_id: r for r in sketches.fingerprint_edits(one).collect()}
    assert len(found) == len(order)
    for at, (i, text) in enumerate(order):
        follow = order[(at + 1) % len(order)][1]
        edited = text[: len(text) - len(text) // 2] + follow[: len(text) // 2]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (hexed(sketch(text)), hexed(sketch(edited)))
        a, b = set(sketch(text)), set(sketch(follow))
        least = set(sorted(a | b)[:128])
        assert r.near_next == (len(least & a & b) / len(least) if least else 1.0)
    assert sketches.fingerprint_edits(none).count() == 0


def test_sketches_merge_and_estimate(spark):
    parts = spark.createDataFrame([("a", " ".join(f"w{i}" for i in range(k, k + 400))) for k in range(0, 4000, 300)], "g string, text string")
    hashed = parts.select("g", sketches.word_hashes(F.col("text")).alias("h")).select("g", sketches.sketch_of(F.col("h")).alias("sketch"))
    merged = sketches.merge_parts(hashed, ["g"])
    union = sorted({h for r in hashed.collect() for h in r.sketch})[:128]
    assert merged.first().sketch == union
    estimate = merged.select(sketches.distinct_count(F.col("sketch"))).first()[0]
    assert 3000 < estimate < 5400
    share = merged.crossJoin(hashed.limit(1).select(F.col("sketch").alias("part"))).select(sketches.containment(F.col("part"), F.col("sketch"))).first()[0]
    assert share > 0.6


def test_the_next_row_across_many_cells(spark):
    ids = [3, 5, 1000, 10**6, 10**6 + 1, 10**12, 2**62, -5]
    docs = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    found = {r.doc_id: r.next_text for r in sketches.with_next(docs, bits=2, few=2).where("NOT guest").collect()}
    order = sorted(ids, reverse=True)
    assert found == {i: str(order[(k + 1) % len(order)]) for k, i in enumerate(order)}


def test_shards_are_the_smallest_possible(docs, texts, none):
    found = sharding.shard_documents(docs, 5).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in found) == sorted((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    groups = Counter()
    for r in docs.select("text").collect():
        groups["-" if r.text is None else hashlib.sha256(r.text.encode()).hexdigest()] += len((r.text or "").encode()) + 8
    sizes = [groups[k] for k in sorted(groups)]

    def fits(capacity):
        shards, used = 1, 0
        for s in sizes:
            shards, used = (shards, used + s) if used + s <= capacity else (shards + 1, s)
        return shards <= 5 and max(sizes) <= capacity

    least = next(c for c in range(max(max(sizes), sum(sizes) // 5), sum(sizes) + 1) if fits(c))
    assert max(Counter({k: sum(r.size for r in found if r.shard == k) for k in slots}).values()) <= least
    assert sharding.shard_documents(none, 5).count() == 0
