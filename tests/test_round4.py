"""The fit on few large blocks: parameters dealt by key, posteriors written only where
they are read again; texts dealt before they become tokens."""

import pytest

from crowdlens.operators import model as M
from crowdlens.operators import vocab as V
from crowdlens.sources import fixtures as FX
from tests.conftest import make_ann
from tests.test_round3 import SF, crowd, near, posteriors, with_words


def test_blocks_are_few(spark):
    slots = spark.sparkContext.defaultParallelism
    assert M._bucket_count(spark, 6_000_000) == slots  # partial sums are blocks x keys
    assert M._bucket_count(spark, 12_000_000 * 2 * slots) == 2 * slots + 1
    numbers = M._block_numbers(spark, 37)
    rows = spark.createDataFrame([(v,) for v in numbers], "block int").repartition(37, "block")
    assert len(set(numbers)) == 37 and all(len(x) == 1 for x in rows.rdd.glom().collect())


@pytest.mark.parametrize("options", [{}, {"split_rows": 3}, {"shrink": 1e-6, "iterations": 12, "tol": 1e-12}])
def test_dealt_parameters_equal_broadcast_ones(spark, options):
    a = crowd(spark, tasks=80, classes=3)
    options = {"iterations": 4, "buckets": 5, **with_words(spark, a), **options}
    sent, dealt = M.fit(a, **options), M.fit(a, broadcast_bytes=0, **options)
    near(posteriors(sent), posteriors(dealt), 1e-9)
    assert [x[1] for x in sent.trace] == pytest.approx([x[1] for x in dealt.trace], abs=1e-6)
    assert sent.worker_alpha.columns == dealt.worker_alpha.columns and "at" not in dealt.word_alpha.columns


def test_dealt_parameters_leave_the_annotations_where_they_are(spark):
    a = crowd(spark)

    @M._by_block
    def plan(ann):
        inp, _, _ = M._prepare(ann, None, None, None, 1_000_000, 4, 0)
        first = M._first_params(inp, M.confusion_prior(2), 2)
        q = M._posterior(M._hashed(inp, first), first, 2, None)
        return q._jdf.queryExecution().executedPlan().toString()

    text = plan(a)
    assert text.count("Exchange hashpartitioning") == 1  # the parameters, to their blocks
    assert "BroadcastHashJoin" not in text and "Bucketed: true" in text


def counted(monkeypatch, name):
    calls, step = [], getattr(M, name)
    monkeypatch.setattr(M, name, lambda *a, **b: calls.append(1) or step(*a, **b))
    return calls


@pytest.mark.parametrize("classes", [3, 9])
def test_only_the_last_posteriors_are_written(spark, monkeypatch, classes):
    a = crowd(spark, tasks=90, classes=classes)
    clamp = spark.createDataFrame([("t1", 1), ("t2", 0)], "task_id string, label int")
    calls = counted(monkeypatch, "_store_q")
    for options in ({}, {"clamp": clamp}):
        kept = M.fit(a, iterations=5, **options)
        calls.clear()
        passed = M.fit(a, iterations=5, trace=False, broadcast_bytes=0, **options)
        assert len(calls) == 1
        near(posteriors(kept), posteriors(passed), 1e-9)
        assert passed.kappa == pytest.approx(kept.kappa, abs=1e-9)


def test_rows_without_a_worker_count_as_before(spark):
    rows = [(f"w{i % 3}" if i % 7 else None, f"t{i % 20}" if i % 11 else None, i % 2, "x", None) for i in range(80)]
    a = make_ann(spark, rows)
    kept, passed = M.fit(a, iterations=4), M.fit(a, iterations=4, trace=False)
    near(posteriors(kept), posteriors(passed), 1e-12)
    assert passed.kappa == pytest.approx(kept.kappa, abs=1e-12)


def test_a_journal_of_rounds_without_posteriors(spark, tmp_path, monkeypatch):
    a, folder = crowd(spark), str(tmp_path / "journal")
    options = {"trace": False, "journal": folder, "broadcast_bytes": 0}
    step, calls = M._m_step, []

    def failing(*args):
        calls.append(1)
        if len(calls) == 4:
            raise RuntimeError("the driver is lost")
        return step(*args)

    monkeypatch.setattr(M, "_m_step", failing)
    with pytest.raises(RuntimeError):
        M.fit(a, iterations=6, **options)
    third = M.fit(a, iterations=3, **options)  # round 3 is taken again: its posteriors were not written
    assert len(calls) == 5
    near(posteriors(M.fit(a, iterations=3)), posteriors(third), 1e-9)
    calls[:] = [1] * 9
    went_on = M.fit(a, iterations=6, buckets=3, **options)  # another layout
    assert len(calls) == 12
    near(posteriors(M.fit(a, iterations=6)), posteriors(went_on), 1e-9)


def test_texts_are_dealt_before_they_become_tokens(spark, monkeypatch):
    plans, placed = [], V.placed

    def seen(df, key, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return placed(df, key, name)

    monkeypatch.setattr(V, "placed", seen)
    V.term_stats(FX.document_rows(spark, SF), stem="none")
    assert plans[0].index("Generate posexplode") < plans[0].index("Exchange hashpartitioning(doc_order")
