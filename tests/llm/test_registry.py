"""Each corpus query on the smallest tables: against its SQL, or for its columns and its rows."""

import pytest

from kvlog.llm import registry
from oracle import SF, holds

COLUMNS = {
    "op1_quality_classifier": ("documents", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
    "op2_simhash_near_dedup": ("documents", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}),
    "op4_decontamination": (None, {"doc_id": "bigint"}),
    "op6_token_counts": ("documents", {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}),
    "op7_packing": (None, dict.fromkeys(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), "bigint")),
    "op9_language_id": ("documents", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}),
    "op10_toxicity": ("documents", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
}


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, name):
    if name in registry.SQL:
        holds(spark, registry.QUERIES[name], registry.SQL[name])
        return
    table, columns = COLUMNS[name]
    found = registry.QUERIES[name](spark, SF)
    assert columns.items() <= dict(found.dtypes).items()
    rows = found.select("doc_id").collect()
    if table:
        assert sorted(rows) == sorted(spark.read.parquet(f"{SF}/{table}.parquet").select("doc_id").collect())


def test_all_ten_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
