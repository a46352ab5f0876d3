"""The registered queries on the smallest data; those with SQL are compared with it in DuckDB."""

import __spark_entry__ as contract
import duckdb
import pytest

from foliant.llm import ORACLES, QUERIES

COLUMNS = {
    "op2_warc_salvage": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op4_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op6_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op7_pack_documents": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op8_context_mixing": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op9_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op10_recompression_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op11_shared_terms": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    "op12_threshold_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op13_hard_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
}


def test_all_are_in_the_entry():
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries()) and len(QUERIES) == 13


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    kinds = dict(df.dtypes)
    assert COLUMNS.get(name, {}).items() <= kinds.items()
    rows = df.collect()
    assert rows
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "embeddings"):
            con.execute(f"create view {t} as from '{data}/{t}.parquet'")
        found = con.execute(ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(str([r[c] for c in names]) for r in rows) == sorted(str(list(r)) for r in found.fetchall())
