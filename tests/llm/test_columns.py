"""Columns of any name come through the stages that give rows back."""

from pyspark.sql import functions as F

from tarnwork.llm import lines, secrets


def test_names_with_backticks_and_dots(spark):
    rows = [(1, "one two three four five\nshared line of more than five words\npassword = abcdefgh12", 0), (2, "other\nshared line of more than five words", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumns({"a`b": F.lit(1), "c.d": F.lit(2), "text_key": F.lit(3)})
    thinned = lines.dedup_lines(docs)
    assert thinned.columns == docs.columns and {r.doc_id: r.text for r in thinned.collect()} == {1: rows[0][1], 2: "other"}
    clean = secrets.redact_secrets(docs)
    assert clean.columns == docs.columns and "abcdefgh12" not in "".join(r.text for r in clean.collect())
