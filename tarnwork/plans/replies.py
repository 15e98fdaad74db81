"""Nested values, structured replies, users' readers and free keys over the demonstration tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.nested import redact_nested
from tarnwork.operators import catalog, replies
from tarnwork.plans._read import read
from tarnwork.plans.analytics import query
from tarnwork.sources.readers import Reader, Registry, Row, combined_rows


@query("""
    SELECT conv_id, count(*) AS n_turns, count_if(turn % 2 = 0) AS n_marks, sum(turn) AS turns FROM conversations GROUP BY conv_id
""")
def redacted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested values, arrays of structs with a map, with a mail address or a name in each text of even turns."""
    turns = read(spark, sf_dir, "conversations")
    note = F.when(F.col("turn") % 2 == 0, F.when(F.col("turn") % 4 == 0, F.lit("Mail a.b@c.org now")).otherwise(F.lit("Patient Name : Jane Roe"))).otherwise("calm")
    nested = turns.groupBy("conv_id").agg(F.collect_list(F.struct("turn", F.create_map(F.lit("note"), note).alias("more"), F.array("role").alias("roles"))).alias("turns"))
    found = redact_nested(nested, ["turns"])
    marks = F.size(F.filter("turns", lambda t: F.contains(t["more"]["note"], F.lit("[REDACTED]")) & ~t["more"]["note"].rlike("@|Jane|Roe")))
    return found.select("conv_id", F.size("turns").cast("long").alias("n_turns"), marks.cast("long").alias("n_marks"), F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["turn"]).alias("turns"))


@query("""
    WITH e AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
    SELECT event_id, CASE WHEN k % 4 = 0 THEN 'Given' WHEN k % 4 = 3 THEN 'Unknown Condition' ELSE 'c' || k END AS condition_name, CASE WHEN k % 2 = 0 THEN 's' || k WHEN k % 4 = 3 THEN '' ELSE 'why' END AS description,
           CASE WHEN k % 4 = 3 THEN 3 WHEN k % 3 = 0 THEN 3 ELSE greatest(1, least(5, k)) END AS confidence_score, CASE WHEN k % 4 = 3 THEN 0 ELSE 5 END AS n_entries, CASE WHEN k % 4 = 3 THEN NULL WHEN k % 5 = 0 THEN 'most likely' ELSE 'possible' END AS likelihood,
           CASE WHEN k % 4 = 3 THEN NULL ELSE 'a|b' END AS supporting, CASE WHEN k % 4 = 3 THEN NULL ELSE 'one' END AS against, k % 6 <> 0 AS follow_up_required, 'x,y' AS false_positives, least(12, k) AS n_patterns FROM e
""")
def normalized_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of many shapes from events, made one shape."""
    k = F.get_json_object("props", "$.k").cast("int")
    text = k.cast("string")
    likelihood = F.when(k % 5 == 0, " Most Likely").otherwise("certain")
    confidence = F.when(k % 3 == 0, F.lit('"high"')).otherwise(F.concat(F.lit('"'), text, F.lit('.7"')))
    entry = F.concat(F.lit('{"condition": " c'), text, F.lit('", "likelihood": "'), likelihood, F.lit('", "confidence": '), confidence, F.lit(', "reasoning": " why ", "supporting": ["a ", "", {"text": " b"}, null], "against": "one"}'))
    more = '"bad", {"likelihood": "possible"}, {"condition_name": "n1"}, {"condition_name": "n2"}, {"condition": "n3"}, {"condition": "n4"}, {"condition": "n5"}'
    differential = F.when(k % 4 == 3, F.lit('"none"')).otherwise(F.concat(F.lit("["), entry, F.lit(f", {more}]")))
    patterns = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), k), lambda i: F.when(i == 0, F.lit('" "')).otherwise(F.concat(F.lit('"p'), i.cast("string"), F.lit('"')))), ", "), F.lit("]"))
    name, summary = F.when(k % 4 == 0, F.lit(' "condition_name": "Given",')).otherwise(""), F.when(k % 2 == 0, F.concat(F.lit(' "summary": " s'), text, F.lit('",'))).otherwise("")
    reply = F.concat(F.lit("{"), name, summary, F.when(k % 6 == 0, F.lit(' "follow_up_required": false,')).otherwise(""), F.lit(' "false_positives": ["x", {"condition": "y", "why": "z"}, {"why": "no name"}, ""], "differential": '), differential, F.lit(', "patterns": '), patterns, F.lit("}"))
    told = read(spark, sf_dir, "events").select("event_id", reply.alias("reply")).select("event_id", F.explode(F.array(replies.normalize_reply("reply"))).alias("r"))
    first = F.get(F.col("r.analysis.differential"), F.lit(0))
    return told.select(
        "event_id", "r.condition_name", "r.description", "r.confidence_score", F.size("r.analysis.differential").alias("n_entries"), first["likelihood"].alias("likelihood"), F.array_join(first["supporting"], "|").alias("supporting"),
        F.array_join(first["against"], "|").alias("against"), "r.follow_up_required", F.array_join(F.transform("r.analysis.false_positives", lambda x: x["condition"]), ",").alias("false_positives"), F.size("r.analysis.patterns").alias("n_patterns"),
    )


def _registry() -> Registry:
    registry = Registry()

    @registry.register
    class Status(Reader):
        """Replaces the rows of closed orders."""

        name, priority = "status", 5

        def matches(self, text):
            return text.startswith("F")

        def parse(self, text):
            return [Row("status", text[0]), Row("size", str(len(text)))]

    @registry.register
    class Broken(Reader):
        name, priority = "broken", 9

        def matches(self, text):
            return True

        def parse(self, text):
            raise ValueError(text)

    @registry.register
    class Priority(Reader):
        """Adds the priority's number, and once more what the base has for open orders."""

        name, mode = "priority", "supplement"

        def matches(self, text):
            return not text.startswith("P")

        def parse(self, text):
            return [Row("priority", text.split("-")[0][-1]), Row("Base ", "b"), Row("priority", text.split("-")[0][-1])]

    return registry


@query("""
    WITH o AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p FROM orders)
    SELECT o_orderkey, NULL AS reader, 'base' AS name, 'b' AS value FROM o WHERE s <> 'F'
    UNION ALL SELECT o_orderkey, 'status', 'status', s FROM o WHERE s = 'F' UNION ALL SELECT o_orderkey, 'status', 'size', CAST(length(s || p) AS VARCHAR) FROM o WHERE s = 'F'
    UNION ALL SELECT o_orderkey, 'priority', 'priority', left(p, 1) FROM o WHERE s <> 'P' UNION ALL SELECT o_orderkey, 'priority', 'Base ', 'b' FROM o WHERE s = 'F'
""")
def plugin_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three registered readers over orders' own: one replaces them, one adds, one fails."""
    docs = read(spark, sf_dir, "orders").select("o_orderkey", F.concat("o_orderstatus", "o_orderpriority").alias("text"))
    base = docs.select("o_orderkey", F.lit(0).alias("no"), F.lit("base").alias("name"), F.lit("b").alias("value"), *[F.lit("").alias(c) for c in ("unit", "reference_range", "status", "section")])
    return combined_rows(base, docs, _registry().readers(), id="o_orderkey", text="text").select("o_orderkey", "reader", "name", "value")


@query("""
    WITH n AS (SELECT p_partkey, replace(p_name, ' ', '_') AS slug, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS nth FROM part),
    x AS (SELECT slug, CASE WHEN slug LIKE 'c%' THEN 0 ELSE 1 END AS bare, slug LIKE '%t' AS third FROM (SELECT DISTINCT slug FROM n))
    SELECT p_partkey, slug || CASE WHEN k = 1 THEN '' ELSE '_' || k END AS key FROM (SELECT p_partkey, slug, CASE WHEN third AND nth + bare >= 3 THEN nth + bare + 1 ELSE nth + bare END AS k FROM n JOIN x USING (slug))
""")
def free_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key for each part by its name; most names are taken as they are, and some with the number 3."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    slugs = part.select(F.translate("p_name", " ", "_").alias("key")).distinct()
    existing = slugs.where("NOT key LIKE 'c%'").unionByName(slugs.where("key LIKE '%t'").select(F.concat("key", F.lit("_3")).alias("key")))
    return catalog.free_keys(part, existing, name="p_name", order=["p_partkey"]).select("p_partkey", "key")
