import pytest

from gridspark.llm.queries import ORACLES, QUERIES
from tests.oracle import connect, differences

SMALL = "/root/testdata/sf0.001"

#: Columns that the contracts name.
COLUMNS = {
    "op1": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op3": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op4": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op5": {"page_id", "host", "path", "rule", "verdict"},
    "op6": {"page_id", "url", "text", "n_chars"},
    "op7": {"query_id", "rank", "vec_id", "score"},
    "op8": {"doc_id", "size", "source_size", "target", "taken"},
    "op9": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op10": {"doc_id", "fingerprint", "component_id"},
    "op11": {"doc_id", "n_features", "weight", "score", "rank"},
    "op12": {"doc_id", "held_out", "score", "predicted"},
    "op13": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert differences(QUERIES[name](spark, SMALL), connect(SMALL), ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_returns_its_columns(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert COLUMNS.get(name.split("_")[0], set()) <= set(df.columns)
    assert df.count() > 0
