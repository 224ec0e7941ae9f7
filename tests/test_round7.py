"""Rounds of a fit with words run on numbers and give what rounds as joins give."""

import math

import numpy as np
import pytest

from crowdlens.functions.special import digamma as digamma_column
from crowdlens.operators import model as M
from crowdlens.operators import rounds as RD
from crowdlens.operators import vocab as V
from crowdlens.streaming import scoring as SC
from pyspark.sql import functions as F
from tests.conftest import make_ann
from tests.test_round3 import crowd, near, posteriors, with_words
from tests.test_round4 import counted


def as_joins(monkeypatch, run):
    with monkeypatch.context() as patch:
        patch.setattr(M, "_numbers_fit", lambda *_: False)
        return run()


def tables(model):
    pairs = {(r.worker_id, r.label): tuple(r[2:]) for r in model.worker_alpha.select(
        "worker_id", "label", *M.p_cols(model.classes, "a_"), *M.p_cols(model.classes, "s_")).collect()}
    return pairs, {r.word_idx: tuple(r[1:]) for r in model.word_alpha.collect()}


@pytest.mark.parametrize("classes,numbered_workers", [(2, False), (3, True)])
def test_rounds_on_numbers_equal_joins(spark, monkeypatch, classes, numbered_workers):
    a = crowd(spark, tasks=40, classes=classes)
    if numbered_workers:
        a = a.withColumn("worker_id", F.pmod(F.xxhash64("worker_id"), F.lit(1 << 40)))
    words = with_words(spark, a)
    # a word twice in one task counts twice
    words["words"] = words["words"].unionByName(words["words"].limit(1))
    monkeypatch.setattr(M, "BLOCK_ROWS", 40)  # more blocks than the tables had before
    monkeypatch.setattr(M, "SLICE_KEYS", 3)
    calls, posterior = counted(monkeypatch, "run_round"), counted(monkeypatch, "_posterior")
    options = {"iterations": 3, "buckets": 3, **words}
    numbers = M.fit(a, **options)
    assert len(calls) == 4 and not posterior  # the priors and three rounds; none of them joins the words
    joined = as_joins(monkeypatch, lambda: M.fit(a, **options))
    near(posteriors(numbers), posteriors(joined), 1e-9)
    assert numbers.kappa == pytest.approx(joined.kappa, abs=1e-9)
    assert numbers.word_totals == pytest.approx(joined.word_totals, abs=1e-9)
    for mine, theirs in zip(tables(numbers), tables(joined)):
        assert mine.keys() == theirs.keys() and mine
        assert all(mine[k] == pytest.approx(theirs[k], abs=1e-9) for k in mine)
    for mine, theirs in zip(numbers.trace, joined.trace):
        assert mine[0] == theirs[0] and mine[1] == pytest.approx(theirs[1], rel=1e-10)
        assert mine[2] is theirs[2] is None or mine[2] == pytest.approx(theirs[2], abs=1e-9)
    assert numbers.trace[-1][2] is not None


def test_rounds_on_numbers_without_trace(spark, monkeypatch):
    a = crowd(spark)
    options = {"iterations": 2, "buckets": 3, "trace": False, **with_words(spark, a)}
    numbers, joined = M.fit(a, **options), as_joins(monkeypatch, lambda: M.fit(a, **options))
    near(posteriors(numbers), posteriors(joined), 1e-9)
    assert [x[1:] for x in numbers.trace] == [(None, None)] * 2


def test_special_functions(spark):
    x = np.concatenate([np.linspace(1, 12, 100), np.logspace(1, 7, 50)])
    exact = np.array([math.lgamma(v) for v in x])
    assert np.abs(RD.lgamma(x) - exact).max() < 1e-11 * np.abs(exact).max()
    assert np.abs(RD.lgamma(x[:100]) - exact[:100]).max() < 1e-12
    column = spark.createDataFrame([(float(v),) for v in x], "x double").select(digamma_column(F.col("x"))).collect()
    assert np.abs(RD.digamma(x) - [r[0] for r in column]).max() < 1e-12


def test_texts_of_a_batch_are_dealt_before_they_become_tokens(spark, monkeypatch, tmp_path):
    texts = ["good news far away", "bad bad news", "", "good far", None, "away"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents")
    a = make_ann(spark, [(f"w{k}", f"t{i}", i % 2, x, None) for i, x in enumerate(texts) for k in range(2)])
    vocab = V.vocabulary(a, stem="none")
    model = M.fit(a, V.task_words(a, vocab, stem="none"), vocab_size=vocab.count(), iterations=1)
    plans, score = [], SC.score_texts

    def noted(model, vocab, docs, *args):
        plans.append(docs._jdf.queryExecution().executedPlan().toString())
        return score(model, vocab, docs, *args)

    monkeypatch.setattr(SC, "score_texts", noted)
    stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/documents")
    sink = f"{tmp_path}/sink"
    SC.score_stream(model, vocab, stream, "doc_id", sink, f"{tmp_path}/checkpoint", stem="none").awaitTermination(300)
    assert plans and all("Exchange hashpartitioning(doc_id" in p for p in plans)
    found = {r.doc_id: r.p_1 for r in spark.read.parquet(sink).collect()}
    assert found.keys() == set(range(6))
    for r in score(model, vocab, docs, "doc_id", stem="none").collect():
        assert found[r.doc_id] == pytest.approx(r.p_1, abs=1e-12)
