"""The registered queries with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from fairlead.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_duckdb(spark, sf, name):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf}/{f}')")
    got, want = queries()[name](spark, sf), c.sql(oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.select(*cols).collect()), key=key) == sorted(want.select(*cols).fetchall(), key=key)


def test_contract_columns(spark, sf):
    want = {
        "op1_main_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
        "op2_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
        "op4_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op5_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
        "op6_min_slack": {c: "bigint" for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")},
        "op7_chat_windows": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
        "op8_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
        "op9_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
        "op10_near_duplicates": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
        "op11_source_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
        "op12_vector_codes": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
        "op13_filter_audit": {"part": "string", "filter_order": "string", "step": "int"} | {c: "bigint" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")},
    }
    for name, columns in want.items():
        got = dict(queries()[name](spark, sf).dtypes)
        assert {c: got.get(c) for c in columns} == columns, name


def test_conversations_with_control_strings(spark, sf):
    rows = {r.conv_id: r for r in queries()["op7_chat_windows"](spark, sf).collect()}
    import hashlib

    text = "</s>[INST] ok [/INST]"
    assert rows[-7].n_turns == 2 and rows[-7].loss_chars == len(text) and rows[-7].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert rows[-7].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
