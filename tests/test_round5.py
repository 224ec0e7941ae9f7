"""Rounds inside packed blocks give what rounds as joins give, and send and write less."""

import pytest

from crowdlens.operators import model as M
from tests.test_round3 import crowd, near, posteriors
from tests.test_round4 import counted


def as_joins(monkeypatch, run):
    with monkeypatch.context() as patch:
        patch.setattr(M, "_packs", lambda *_: False)
        return run()


def test_packed_rounds_equal_joins(spark, monkeypatch):
    a = crowd(spark, tasks=40, classes=3)
    given = spark.createDataFrame([("t1", 1), ("t2", 0), ("none", 1)], "task_id string, label int")
    calls = counted(monkeypatch, "_block_sums")
    options = {"iterations": 3, "buckets": 3, "trace": False, "clamp": given}
    packed = M.fit(a, **options)
    assert len(calls) == 3
    joined = as_joins(monkeypatch, lambda: M.fit(a, **options))
    near(posteriors(packed), posteriors(joined), 1e-9)
    assert packed.kappa == pytest.approx(joined.kappa, abs=1e-9)


def test_packed_rounds_send_only_parameters(spark):
    a = crowd(spark)

    @M._by_block
    def plan(ann):
        inp, _, _ = M._prepare(ann, None, None, None, 1_000_000, 4, 1 << 20)
        inp = M.replace(inp, bc_pairs=False, bc_words=False)
        first = M._first_params(inp, M.confusion_prior(2), 2)
        inp = M.replace(inp, packed=M._packed(inp, first, 2, None))
        return M._block_sums(inp, first, None, 2, 0.0)._jdf.queryExecution().executedPlan().toString()

    text = plan(a)
    assert text.count("Exchange hashpartitioning") == 1  # the parameters, to their blocks
    assert "BroadcastHashJoin" not in text and "Bucketed: true" in text
