"""Nested values, replies of any shape, users' readers, and free keys."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwork.functions.nested import map_texts, redact_nested
from tarnwork.operators import catalog, merging, replies
from tarnwork.sources.readers import Reader, Registry, Row, combined_rows, read_rows


def test_texts_at_any_depth(spark):
    schema = "id int, v struct<a: string, `b.c`: array<struct<m: map<string, array<string>>, n: int>>, e: struct<x: binary>>, w string"
    rows = [(1, ("mail a@b.co", [({"a@b.co": ["to a@b.co", None]}, 5), (None, None), None], (b"a@b.co",)), "a@b.co"), (2, (None, None, None), None), (3, None, "x")]
    found = redact_nested(spark.createDataFrame(rows, schema), ["v"]).orderBy("id").collect()
    assert [r.w for r in found] == ["a@b.co", None, "x"] and found[2].v is None and tuple(found[1].v) == (None, None, None)
    v = found[0].v
    assert v.a == "mail [REDACTED]" and v.e.x == b"a@b.co"
    assert [None if x is None else (x.m, x.n) for x in v["b.c"]] == [({"a@b.co": ["to [REDACTED]", None]}, 5), (None, None), None]
    df = spark.createDataFrame([([["a", None], None],)], "v array<array<string>>")
    assert df.select(map_texts(F.col("v"), df.schema["v"].dataType, F.upper)).first()[0] == [["A", None], None]


def test_replies_of_any_shape(spark):
    cases = {
        None: ("Unknown Condition", "", 3, True, 0, [], []),
        "no json": ("Unknown Condition", "", 3, True, 0, [], []),
        "[1]": ("Unknown Condition", "", 3, True, 0, [], []),
        '{"differential": "x", "confidence_score": "9"}': ("Unknown Condition", "", 5, True, 0, [], []),
        '{"differential": [{"condition": "A", "confidence": 4.9, "reasoning": "r", "supporting": 5}], "follow_up_required": 0}': ("A", "r", 4, False, 1, ["5"], []),
        '{"description": "d", "condition_name": "", "differential": [{"condition_name": " B "}], "confidence_score": -3, "patterns": {"text": "no list"}}': ("B", "d", 1, True, 1, [], []),
        '{"patterns": "one", "differential": [{"condition": "C", "confidence": "x"}, null, [], 7]}': ("C", "", 3, True, 1, [], ["one"]),
    }
    df = spark.createDataFrame([(k,) for k in cases], "reply string").select("reply", F.explode(F.array(replies.normalize_reply("reply"))).alias("r"))
    told = {x.reply: (x.r.condition_name, x.r.description, x.r.confidence_score, x.r.follow_up_required, len(x.r.analysis.differential), x.r.analysis.differential[0].supporting if x.r.analysis.differential else [], x.r.analysis.patterns) for x in df.collect()}
    assert told == cases
    long = '{"differential": [{"condition": "' + "c" * 300 + '", "against": ["' + "t" * 700 + '"]}], "cautions": [' + ", ".join(f'"{i}"' for i in range(20)) + "]}"
    r = spark.createDataFrame([(long,)], "reply string").select(replies.normalize_reply("reply")).first()[0]
    assert (len(r.condition_name), len(r.analysis.differential[0].against[0]), len(r.analysis.cautions)) == (200, 600, 12)


def test_readers_by_registration(spark, tmp_path):
    registry = Registry()
    with pytest.raises(TypeError):
        registry.register(int)
    with pytest.raises(ValueError):
        registry.register(type("NoName", (Reader,), {}))
    with pytest.raises(ValueError):
        registry.register(type("BadMode", (Reader,), {"name": "x", "mode": "other"}))
    body = "from tarnwork.sources.readers import Reader, Row\nclass {0}(Reader):\n    name, priority, mode = '{0}', {1}, '{2}'\n    def matches(self, text):\n        return '{3}' in text\n    def parse(self, text):\n        return [Row('n', '{0}'), ('m', text)]\n"
    for i, (name, priority, mode, word) in enumerate([("low", 1, "replace", "x"), ("high", 7, "replace", "xx"), ("tie", 7, "replace", "xx"), ("more", 3, "supplement", "")]):
        (tmp_path / f"r{i}.py").write_text(body.format(name, priority, mode, word))
    (tmp_path / "_skipped.py").write_text("1 / 0")
    (tmp_path / "broken.py").write_text("1 / 0")
    assert registry.load(str(tmp_path), ["no.such.module"]) == [str(tmp_path / "broken.py"), "no.such.module"]
    registry.load(str(tmp_path))  # once more: the names are known
    readers = registry.readers()
    assert [r.name for r in readers] == ["high", "tie", "more", "low"]
    docs = spark.createDataFrame([(1, "x"), (2, "xx"), (3, "y"), (4, None)], "id int, text string")
    assert read_rows(docs, readers, id="id", text="text").where("id = 4").count() == 2
    base = spark.createDataFrame([(i, 0, "N ", "more", "", "", "", "") for i in range(1, 5)] + [(1, 1, "N ", "more", "", "", "", "")], "id int, no int, name string, value string, unit string, reference_range string, status string, section string")
    found = sorted((r.id, r.reader or "", r.name, r.value) for r in combined_rows(base, docs, readers, id="id", text="text").collect())
    assert found == sorted([(1, "low", "n", "low"), (1, "low", "m", "x"), (1, "more", "n", "more"), (2, "high", "n", "high"), (2, "high", "m", "xx"), (2, "more", "n", "more"), (3, "", "N ", "more"), (3, "more", "m", "y"), (4, "", "N ", "more"), (4, "more", "m", "")])


def test_ties_of_replacing_readers(spark):
    base = spark.createDataFrame([("d", "a", "0"), ("d", "a", "0")], "doc string, name string, value string")
    extra = spark.createDataFrame([("d", "b", "1", "replace", 5, "y"), ("d", "c", "2", "replace", 5, "x"), ("d", "c", "2", "replace", 5, "x")], "doc string, name string, value string, mode string, priority int, reader string")
    found = merging.replace_or_supplement(base.withColumn("reader", F.lit(None).cast("string")), extra, keys=["doc", "name"], group=["doc"])
    assert [(r.name, r.reader) for r in found.collect()] == [("c", "x"), ("c", "x")]


def test_keys_fill_gaps(spark):
    rng = random.Random(3)
    names = [rng.choice(["A b", "a-B", "c", "A b 2", "C 3", "!!", "c 02"]) for _ in range(60)]
    existing = {"c", "c_3", "c_4", "a_b_2", "c_02"}
    slug = lambda n: "_".join("".join(x if x.isalnum() else " " for x in n.lower()).split())
    served, expected, numbered = {}, {}, {slug(n) for n in names if slug(n)[-1:].isdigit()}
    for i, n in enumerate(names):
        s, k = slug(n), 0
        for k in range(1, 500):
            made = s if k == 1 else f"{s}_{k}"
            if made not in served.get(s, ()) and made not in existing and (k == 1 or made not in numbered):
                break
        served.setdefault(s, set()).add(made)
        expected[i] = made if s else None
    new = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    found = {r.id: r.key for r in catalog.free_keys(new, spark.createDataFrame([(k,) for k in existing], "key string"), name="name", order=["id"]).collect()}
    assert found == expected
    keys = [k for k in found.values() if k]
    assert len(set(keys)) == len(keys) and not set(keys) & existing
