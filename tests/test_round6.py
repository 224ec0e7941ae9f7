"""What a fit with words sends to the driver: nothing in a round, and no table that grows
with the input by its file size."""

import pytest

from crowdlens.operators import mapping as MP
from crowdlens.operators import model as M
from crowdlens.operators import vocab as V
from crowdlens.session import cut, setting
from crowdlens.sources import fixtures as FX
from tests.conftest import make_ann
from tests.test_round3 import crowd, near, posteriors, with_words


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounds_broadcast_no_parameters_however_small(spark):
    a = crowd(spark)

    @M._by_block
    def plans(ann):
        given = with_words(spark, ann)
        inp, _, _ = M._prepare(ann, None, given["words"], given["vocab_size"], 1_000_000, 4, M.ROUND_BYTES)
        first = M._first_params(inp, M.confusion_prior(2), 2)
        inp = M._hashed(inp, first)
        return plan(M._posterior(inp, first, 2, None)), plan(M._unlabelled(inp.words, inp.ann, inp.keys, inp.hash_join))

    e_step, unlabelled = plans(a)
    assert "BroadcastHashJoin" not in e_step
    assert "Broadcast" not in unlabelled and "Exchange" not in unlabelled  # found in the blocks


def test_words_without_annotation_are_still_seen(spark):
    a = crowd(spark)
    given = with_words(spark, a)
    more = spark.createDataFrame([("words only", 0), ("words only", 1)], "task_id string, word_idx long")
    words = given["words"].select("task_id", "word_idx").unionByName(more)
    options = {"iterations": 3, "words": words, "vocab_size": given["vocab_size"], "split_rows": 1_000_000}
    dealt, plain = M.fit(a, buckets=3, **options), M.fit(a, co_locate=False, **options)
    near(posteriors(dealt), posteriors(plain), 1e-9)
    assert "words only" in posteriors(dealt)


@pytest.mark.parametrize("stem", ["none", "porter2"])
def test_a_large_vocabulary_is_dealt_by_term(spark, monkeypatch, stem):
    texts = ["Runs running far", "far runs far", "", "a b c", "c b a b"]
    a = make_ann(spark, [("w1", f"t{i}", 0, x, None) for i, x in enumerate(texts)] + [("w2", "t0", 1, "other words", None)])
    vocab = V.vocabulary(a, stem=stem)
    sent = V.task_words(a, vocab, stem=stem)
    monkeypatch.setattr(V, "VOCAB_BYTES", 0)
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    dealt = V.task_words(a, vocab, stem=stem)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before
    rows = sorted(dealt.collect())
    assert rows == sorted(sent.collect()) and len(rows) == len(set(rows)) > 5
    assert "Broadcast" not in plan(dealt)  # its file is far below what Spark broadcasts by itself


def test_label_table_is_joined_one_row_a_document(spark, tmp_path):
    ids = [0, 1, 2, 2, 7, 23, -5, None]
    spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1), (2, 0), (2, 1), (7, None), (23, 1), (-5, 0), (99, 1), (None, 1)],
                          "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    a = FX.text_annotations(spark, str(tmp_path))
    seen = sorted((r.row_id, r.worker_id, r.body_text) for r in a.collect())
    joined = [0, 2, 2, 2, 2, 7, 23, -5]

    def rest(x):  # the sign of the dividend, as in SQL
        return x % 12 if x >= 0 else -(-x % 12)

    assert seen == sorted((d * 100 + k, f"w{k}", f"text {d}") for d in joined for k in range(12) if rest(d * 7 + k * 13) < 4)
    text = a._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Generate") < text.index("Join")  # above it: the labels are not multiplied before


def test_settings_come_back(spark):
    key = "spark.sql.files.maxRecordsPerFile"
    before = spark.conf.get(key, None)
    with pytest.raises(ZeroDivisionError), setting(spark, {key: "7"}):
        assert spark.conf.get(key) == "7"
        1 / 0
    assert spark.conf.get(key, None) == before
    assert cut(spark.range(3)).count() == 3
    assert MP.task_text(make_ann(spark, [("w", "t", 0, "x", None)])).first()["body_text"] == "x"
