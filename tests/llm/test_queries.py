import pytest

from checks.compare import compare, connect
from holdfast.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_DIR


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert compare(spark, connect(SF_DIR), SF_DIR, QUERIES[name], ORACLES[name]) == ""


@pytest.mark.parametrize("name,columns", [
    ("op5_quality_classifier", ["doc_id", "held_out", "score", "predicted"]), ("op7_bpe", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]),
    ("op9_pii", ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_terms"]), ("op2_jaccard_join", ["doc_id", "class_id", "n_links", "n_copies"]),
])
def test_one_row_per_document(spark, name, columns):
    got = QUERIES[name](spark, SF_DIR)
    ids = [r["doc_id"] for r in got.collect()]
    assert got.columns == columns and len(ids) == len(set(ids)) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
