"""The driver's correctness gate on a small scale: Spark plans vs DuckDB SQL."""

import pytest

from crowdlens.plans import catalog

from tests.oracle_check import compare

SF = "/root/testdata/sf0.001"
KEYS = ["majority_vote", "gold_per_task", "worker_index", "quality_summary",
        "tfidf_l2", "vocab_first_seen", "task_words", "vb_fit", "vb_labels_only",
        "roc_auc", "report_words", "load_rejects", "load_tsv", "stem_tokens", "vocab_stemmed", "task_words_stemmed",
        "quality_faults", "dataset_faults", "majority_vote_given", "true_labels", "class_prior"]


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, key):
    rec = compare(spark, SF, [key])[key]
    assert "error" not in rec, rec
    assert rec.get("cols") and rec.get("match"), rec


def test_every_query_has_sql_or_is_rows_only():
    import __spark_entry__ as e
    qs, sqls = e.queries(), e.oracle_sql()
    assert set(sqls) <= set(qs)
    assert set(catalog.QUERIES) <= set(qs)
    assert set(catalog.QUERIES) - set(sqls) == set()


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["task_id", "p_0", "p_1", "predicted"]
    assert df.count() > 0
