"""Periodic runs against a plain search, and the number of comparisons on hard inputs."""

import hashlib
import random
import zlib

import pytest

from tarnwork.llm import runs


def plain_runs(words, least_length, least_exponent):
    found, n = set(), len(words)
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            k = i
            while k + q < n and words[k] == words[k + q]:
                k += 1
            if k + q - i >= max(least_length, least_exponent * q):
                piece = words[i : k + q]
                if not any(all(piece[t] == piece[t + d] for t in range(len(piece) - d)) for d in range(1, q)):
                    found.add((i, k + q - i, q))
            i = k
    return sorted(found, key=lambda r: (r[0], r[2]))


class Counted(int):
    compared = 0

    def _count(name):
        def compare(self, other):
            Counted.compared += 1
            return getattr(int, name)(self, other)

        return compare

    __lt__, __gt__, __eq__, __hash__ = _count("__lt__"), _count("__gt__"), _count("__eq__"), int.__hash__


def _hard(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    rng = random.Random(4)
    square = [rng.randrange(3) for _ in range(n // 8)]
    nested = [0]
    for k in range(1, 40):
        nested = nested + [k] + nested if len(nested) < n else nested
    return {
        "fibonacci": b[:n], "thue_morse": [bin(i).count("1") % 2 for i in range(n)], "one": [0] * n, "one_then_less": [1] * (n - 1) + [0], "one_then_more": [1] * (n - 1) + [2],
        "period": [0, 1, 0, 0, 1, 1, 0] * (n // 7), "falling": [n - i // 2 for i in range(n)], "binary": [rng.randrange(2) for _ in range(n)], "squares": square * 8,
        "nested": nested[:n], "blocks": [int(i % (1 + i // 50) == 0) for i in range(n)], "ruler": [(i & -i).bit_length() for i in range(1, n)],
    }


def test_runs_equal_a_plain_search():
    rng = random.Random(2)
    cases = [[rng.randrange(k) for _ in range(rng.randrange(0, 60))] for k in (1, 2, 2, 2, 3, 4) for _ in range(250)]
    for k in range(300):
        base = [rng.randrange(3) for _ in range(rng.randrange(1, 7))] * rng.randrange(1, 9)
        for _ in range(rng.randrange(3)):
            base[rng.randrange(len(base))] = rng.randrange(3)
        cases.append(base + [rng.randrange(3) for _ in range(rng.randrange(4))] + base[: rng.randrange(len(base) + 1)])
    cases += [x[:150] for x in _hard(150).values()]
    for s in cases:
        for length, exponent in ((2, 2), (3, 3), (6, 4)):
            assert runs.runs(s, length, exponent) == plain_runs(s, length, exponent), s


def test_next_smaller_suffixes():
    rng = random.Random(5)
    for _ in range(600):
        s = [rng.randrange(rng.choice((1, 2, 3))) for _ in range(rng.randrange(40))]
        after, agree = runs.lyndon(s)
        for i in range(len(s)):
            j = next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s))
            assert after[i] == j
            assert agree[i] == next((m for m in range(len(s) - j) if s[i + m] != s[j + m]), len(s) - j)


@pytest.mark.parametrize("name", _hard(64))
def test_comparisons_are_linear(name):
    counts = []
    for n in (4000, 32000):
        s = [Counted(x) for x in _hard(n)[name]]
        Counted.compared = 0
        runs.lyndon(s)
        counts.append(Counted.compared / len(s))
    assert counts[1] < 8 and counts[1] < 1.2 * counts[0] + 0.5, counts


def test_machine_integers_give_the_same(monkeypatch):
    expected = {k: runs.runs(s, 2, 2) for k, s in _hard(500).items()}
    monkeypatch.setattr(runs, "LONG", 10)
    assert {k: runs.runs(s, 2, 2) for k, s in _hard(500).items()} == expected


def _expected(doc_id, text):
    words = [w.encode() for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words, 6, 4)
    gone = {i for a, length, q in found for i in range(a + q, a + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{length},{q}\n" for a, length, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_rows(spark, docs, texts, none):
    short = docs.where("length(coalesce(text, '')) < 6000")
    found = sorted(map(tuple, runs.find_runs(short, change=runs._with_tail).drop("runs").collect()), key=str)
    assert found == sorted((_expected(i, t) for i, t in texts if len(t) < 6000), key=str)
    assert any(r[1] for r in found)
    assert runs.find_runs(none).count() == 0


def test_runs_are_collapsed(spark):
    rows = [(1, "a b " * 4 + "c"), (2, None), (None, "x " * 9), (3, "no  runs\there"), (3, "no  runs\there")]
    out = runs.collapse_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(1, "a b c"), (2, ""), (None, "x"), (3, "no  runs\there"), (3, "no  runs\there")], key=str)
