"""Spark operators against brute-force Python on random inputs."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdlens.operators import evaluate as E
from crowdlens.operators import mapping as MP
from crowdlens.operators import model as M
from tests.conftest import make_ann


def _random_rows(seed, n=120, workers=6, tasks=15, labels=3, hot=None):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        t = hot if hot is not None and i % 3 == 0 else f"t{rnd.randrange(tasks)}"
        rows.append((f"w{rnd.randrange(workers)}", t, rnd.randrange(labels), "x", None))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_majority_vote_brute_force(spark, seed):
    rows = _random_rows(seed)
    ann = make_ann(spark, rows)
    got = {r.task_id: r.majority_label for r in MP.majority_vote(ann).collect()}
    want = {}
    by_task = defaultdict(list)
    for i, (w, t, l, _, _) in enumerate(rows):
        by_task[t].append((i, l))
    for t, items in by_task.items():
        cnt = Counter(l for _, l in items)
        first = {}
        for i, l in items:
            first.setdefault(l, i)
        best = max(cnt.values())
        want[t] = min((first[l], l) for l in cnt if cnt[l] == best)[1]
    assert got == want


@pytest.mark.parametrize("seed", [5, 6])
def test_grid_auc_equals_mann_whitney(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(60):
        g = rnd.randrange(2)
        s = round(min(1.0, max(0.0, rnd.gauss(0.35 + 0.3 * g, 0.2))), 3)
        rows.append((str(i), g, 1 - s, s))
    pred = spark.createDataFrame(rows, "task_id string, gold int, p_0 double, p_1 double") \
        .withColumn("predicted", (F.col("p_1") > 0.5).cast("int")) \
        .withColumn("p_gold", F.when(F.col("gold") == 1, F.col("p_1")).otherwise(F.col("p_0")))
    auc = E.roc_auc(E.roc_points(pred)).first().auc
    pos = [r[3] for r in rows if r[1] == 1]
    neg = [r[3] for r in rows if r[1] == 0]
    mw = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    assert auc == pytest.approx(mw / (len(pos) * len(neg)), abs=1e-9)


def _digamma(x):
    return M._digamma_py(float(x))


def _numpy_fit(rows, c, rounds, diag=5.5):
    """Reference coordinate ascent of the same update equations (labels only)."""
    tasks = sorted({t for _, t, _, _, _ in rows})
    workers = sorted({w for w, _, _, _, _ in rows})
    ti = {t: i for i, t in enumerate(tasks)}
    wi = {w: i for i, w in enumerate(workers)}
    prior = np.where(np.eye(c) == 1, diag, 1.0)
    pi = np.repeat(prior[None, :, :], len(workers), axis=0)  # k, true, label
    kappa = np.ones(c)
    dg = np.vectorize(_digamma)
    q = None
    for _ in range(rounds):
        elk = dg(kappa) - _digamma(kappa.sum())
        elpi = dg(pi) - dg(pi.sum(axis=2, keepdims=True))
        s = np.tile(elk, (len(tasks), 1))
        for w, t, l, _, _ in rows:
            s[ti[t]] += elpi[wi[w], :, l]
        s -= s.max(axis=1, keepdims=True)
        q = np.exp(s) / np.exp(s).sum(axis=1, keepdims=True)
        kappa = 1.0 + q.sum(axis=0)
        pi = np.repeat(prior[None, :, :], len(workers), axis=0)
        for w, t, l, _, _ in rows:
            pi[wi[w], :, l] += q[ti[t]]
    return {t: q[ti[t]] for t in tasks}


@pytest.mark.parametrize("seed,hot", [(11, None), (12, "hot")])
def test_fit_matches_numpy(spark, seed, hot):
    rows = _random_rows(seed, n=150, hot=hot)
    ann = make_ann(spark, rows)
    # split_rows small enough that the hot task (a third of all rows) is salted
    m = M.fit(ann, None, iterations=3, split_rows=20)
    got = {r.task_id: [r.p_0, r.p_1, r.p_2] for r in m.q.collect()}
    want = _numpy_fit(rows, 3, 3)
    assert set(got) == set(want)
    for t in want:
        assert got[t] == pytest.approx(list(want[t]), abs=1e-9)


def test_fit_shuffle_join_with_hot_worker(spark):
    # one worker gives a third of all labels; force the non-broadcast path
    rows = _random_rows(21, n=150)
    rows = [("whot",) + r[1:] if i % 3 == 0 else r for i, r in enumerate(rows)]
    ann = make_ann(spark, rows)
    m = M.fit(ann, None, iterations=3, trace=False, broadcast_bytes=0, split_rows=20)
    got = {r.task_id: [r.p_0, r.p_1, r.p_2] for r in m.q.collect()}
    want = _numpy_fit(rows, 3, 3)
    for t in want:
        assert got[t] == pytest.approx(list(want[t]), abs=1e-9)
