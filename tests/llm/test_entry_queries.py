"""The columns of each query on the smallest tables, and the rows of those that have SQL."""

import duckdb
import pytest

from tarnwork.llm.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_bottom_k_sketches": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op2_link_trust": "page_id host path rule verdict",
    "op3_circulant_minhash": "doc_id n_shingles component_id kept",
    "op4_minimax_shards": "doc_id size text_crc32 law shard slot grown_shard",
    "op5_polynomial_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op6_toxicity": "doc_id held_out score predicted",
    "op7_line_dedup": "doc_id n_lines n_removed text_sha256",
    "op8_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op9_secret_scans": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op10_cost_balanced_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op11_wand_search": "item_id rank doc_id score",
    "op12_bit_packed_ids": "doc_id start n_tokens ids_crc32",
    "op13_lyndon_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    wanted = COLUMNS[name].split()
    found = QUERIES[name](spark, SF_DIR)
    assert set(wanted) <= set(found.columns)
    rows = found.select(*wanted).collect()
    table = {"op2_": "pages", "op11": "benchmark"}.get(name[:4], "documents")
    ids = [r[0] for r in spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(wanted[0]).collect()]
    assert sorted({r[0] for r in rows}) == sorted(ids) and (len(rows) == len(ids) or name.startswith(("op10_", "op11_")))
    if name.startswith("op4_"):
        assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    if name.startswith("op6_"):
        assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    if name in SQL:
        duck = duckdb.connect()
        for view in ("documents", "benchmark"):
            duck.sql(f"CREATE VIEW {view} AS FROM '{SF_DIR}/{view}.parquet'")
        expected = duck.sql(f"SELECT {', '.join(wanted)} FROM ({SQL[name]})").fetchall()
        assert sorted(map(tuple, rows), key=str) == sorted(expected, key=str)
