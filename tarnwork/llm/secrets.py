"""Secret scans with an incremental ledger of blobs.

A blob is a distinct text, addressed by its SHA-256; every row of every version of the documents is a path to one. The
ledger holds a row for each blob and rule version that has been scanned, with what was found. A scan looks up which
pairs of blob and rule version are missing, scans one text for each, and joins findings back to all paths.

Spans come from built-in functions alone: ``split`` gives what lies between the matches of a rule and
``regexp_extract_all`` the matches, and running sums of their lengths give the places. Sums run per text and rule, over
rows that hold lengths only.

Defined results: a null text is the empty blob; repeated rows are further paths to one blob; an empty table gives no
rows; further columns of the input are not carried; places are code points, ends exclusive.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwork.llm._common import documents, materialize, quoted, sha256_hex, small


class Rule(NamedTuple):
    """``pattern`` is matched leftmost and without overlaps; matches stay whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True


#: Runs that are too short can't hold a long one, so ``access`` and ``hex`` ask for the length in the pattern.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
)
RULE_VERSION = "1"
LEDGER = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base string, spans string"


def _blob() -> F.col:
    return sha256_hex(F.coalesce("text", F.lit("")))


def _at_least(characters: int):
    return lambda x: F.length(x) >= characters


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, spans array<struct<start, rule, end, kind>>`` of those rows of ``blobs(blob, text)`` that hold any, in order."""
    any_rule = "|".join(f"(?:{r.pattern})" for r in rules)
    found = [
        F.struct(
            F.lit(i).alias("rule"),
            F.transform(F.split("text", r.pattern, -1), F.length).alias("gaps"),
            F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)), F.length).alias("sizes"),
            F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)), _at_least(r.least)).alias("good"),
        )
        for i, r in enumerate(rules)
    ]
    suspect = blobs.where(F.col("text").rlike(any_rule)).select("blob", "text", F.monotonically_increasing_id().alias("row"))
    hits = suspect.select("blob", "row", F.explode(F.array(*found)).alias("f"))
    hits = hits.select("blob", "row", "f.rule", F.posexplode(F.arrays_zip("f.gaps", "f.sizes", "f.good")).alias("i", "m")).select("blob", "row", "rule", "i", "m.*").where("sizes IS NOT NULL")
    before = Window.partitionBy("blob", "row", "rule").orderBy("i")
    end = F.sum(F.col("gaps") + F.col("sizes")).over(before)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rule") + 1)
    spans = hits.select("blob", "row", "rule", "good", (end - F.col("sizes")).alias("start"), end.alias("end"), kind.alias("kind")).where("good")
    return spans.groupBy("blob", "row").agg(F.array_sort(F.collect_list(F.struct("start", "rule", "end", "kind"))).alias("spans")).drop("row").dropDuplicates(["blob"])


def _written(spans: F.col) -> F.col:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_ledger(docs: DataFrame, ledger: DataFrame | None = None, *, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger lacks for ``docs(doc_id, text)``.

    Returns a row for each row of ``docs`` (``doc_id, blob, n_assign, n_access, n_hex, base, spans``), and the
    ledger's new rows, which the caller appends to it.
    """
    spark = docs.sparkSession
    ledger = spark.createDataFrame([], LEDGER) if ledger is None else ledger
    seen = ledger.where(F.col("rule_version") == rule_version)
    paths = materialize(docs.select("doc_id", _blob().alias("blob")), "secret-paths")
    unseen = materialize(paths.groupBy("blob").agg(F.min("doc_id").alias("path")).join(seen, "blob", "left_anti"), "secret-unseen")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # doc_id finds the row; the blob is looked at again, as doc_ids may repeat.
    chosen = texts.join(small(unseen, 100_000), F.col("doc_id").eqNullSafe(F.col("path"))).where(_blob() == F.col("blob")).select("blob", "text")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base_kinds = [r.kind for r in rules if r.base]
    base = _written(F.filter("spans", lambda s: s["kind"].isin(base_kinds)))
    hits = materialize(scan_blobs(chosen, rules).select("blob", *[number(k) for k in ("assign", "access", "hex")], base.alias("base"), _written(F.col("spans")).alias("spans")), "secret-hits")
    numbers = ["n_assign", "n_access", "n_hex"]

    def with_defaults(frame: DataFrame, *columns) -> DataFrame:
        return frame.select(*columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], *[F.coalesce(c, F.lit("")).alias(c) for c in ("base", "spans")])

    fresh = with_defaults(unseen.select("blob").join(small(hits, 100_000), "blob", "left"), "blob", F.lit(rule_version).alias("rule_version"))
    known = seen.where("spans <> ''").select("blob", *numbers, "base", "spans").unionByName(hits)
    known = small(materialize(known, "secret-known"), 100_000)
    return with_defaults(paths.join(known, "blob", "left"), "doc_id", "blob"), fresh


def redact_secrets(docs: DataFrame, mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with a mark in place of each span that a scan finds; all rows and columns stay, whatever their names.

    Overlapping spans of several rules become one mark. Null texts stay null; rows of equal texts change alike, with or
    without a doc_id; an empty table gives no rows.
    """
    found, _ = scan_ledger(docs, rules=rules)
    marked = found.where("spans <> ''").select("blob", "spans").distinct()
    places = F.transform(F.split("spans", ","), lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("a"), F.split(s, ":")[2].cast("int").alias("b")))
    marked = small(materialize(marked.select("blob", places.alias("places")), "secret-marked"), 50_000)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    text, places = docs["text"], marked["places"]

    def step(s, x):
        apart = F.concat(s["parts"], F.array(F.substring(text, s["at"] + 1, x["a"] - s["at"]), F.lit(mark)))
        return F.struct(F.greatest(s["at"], x["b"]).alias("at"), F.when(x["a"] >= s["at"], apart).otherwise(s["parts"]).alias("parts"))

    clean = F.aggregate(places, state, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    joined = docs.join(marked, sha256_hex(F.coalesce(text, F.lit(""))) == marked["blob"], "left")
    new_text = F.when(places.isNull(), text).otherwise(clean)
    new = {"text": new_text.alias("text"), "n_chars": F.length(new_text).cast("long").alias("n_chars")}
    return joined.select(*[new[c] if c in new else docs[quoted(c)] for c in docs.columns])


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all ``documents``: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``; cases are those of the module."""
    found, _ = scan_ledger(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def _sql(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, '{kind}' AS kind, {order} AS ord, unnest(string_split_regex(x, '{quoted}')) AS gap, unnest(regexp_extract_all(x, '{quoted}', 0)) AS m,
           unnest(regexp_extract_all(x, '{quoted}', {group})) AS v, generate_subscripts(string_split_regex(x, '{quoted}'), 1) AS i, {least} AS least FROM t"""


OP9_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
m AS ({" UNION ALL ".join(_sql(r.kind, i, {"access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}.get(r.kind, r.pattern), r.group, {"access": 16, "hex": 32}.get(r.kind, r.least)) for i, r in enumerate(RULES))}),
placed AS (SELECT *, sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM m),
spans AS (SELECT doc_id, kind, ord, stop - length(m) AS start, stop, kind || ':' || CAST(stop - length(m) AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM placed WHERE m IS NOT NULL AND length(v) >= least),
by_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY start, ord) FILTER (kind <> 'pem') AS base, string_agg(span, ',' ORDER BY start, ord) AS spans
  FROM spans GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN by_doc USING (doc_id)
"""
