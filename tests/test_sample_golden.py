"""Hand-computed goldens for the 20-row sample (FIXTURES.md section 4)."""

import math

import pytest
from pyspark.sql import functions as F

from crowdlens.operators import mapping as MP
from crowdlens.operators import model as M
from crowdlens.operators import quality as Q
from crowdlens.operators import vocab as V


def test_quality_domains(sample):
    issues = Q.row_issues(sample, labels=(0, 1))
    errs = issues.where(F.col("severity") == "error").select("row_id").collect()
    assert sorted(r.row_id + 1 for r in errs) == [2, 4, 9, 10, 11, 12, 16, 17, 18, 20]
    assert Q.row_issues(sample, labels=(1, 2)).count() == 0
    s = Q.summary(sample, labels=(0, 1)).first()
    assert (s.total_records, s.valid_records, s.n_errors) == (20, 10, 10)
    assert s.is_valid is False


def test_majority_and_first_text(sample):
    mv = {r.task_id: r.majority_label for r in MP.majority_vote(sample).collect()}
    assert mv == {"10": 1, "20": 2, "30": 1, "40": 2}
    txt = {r.task_id: r.body_text for r in MP.task_text(sample).collect()}
    assert txt["10"] == "this if fine"
    assert V.corpus(sample).count() == 5


def test_vocabulary_idf_and_task_words(sample):
    vocab = V.vocabulary(sample, stem="porter2")
    assert [(r.word_idx, r.term) for r in vocab.orderBy("word_idx").collect()] == \
        [(0, "fine"), (1, "good")]
    stats = V.term_stats(sample, stem="porter2")
    idf = {r.term: r.idf for r in V.idf(stats).collect()}
    assert idf["fine"] == pytest.approx(math.log(5 / 4), abs=1e-6)
    assert idf["good"] == pytest.approx(math.log(5 / 3), abs=1e-6)
    w = V.tfidf_l2(stats).collect()
    assert all(r.weight == pytest.approx(1.0) for r in w)
    tw = {r.task_id: r.word_idx for r in V.task_words(sample, vocab, stem="porter2").collect()}
    assert tw == {"10": 0, "20": 0, "30": 1, "40": 1}


GOLDEN = {
    1: ([0.100805, 0.899195, 0.001407, 0.998593], -19.430723),
    2: ([0.086854, 0.913146, 0.001940, 0.998060], -19.427931),
    3: ([0.085181, 0.914819, 0.001902, 0.998098], -19.427889),
}


@pytest.fixture(scope="module")
def sample_words(sample):
    vocab = V.vocabulary(sample, stem="porter2")
    return vocab, V.task_words(sample, vocab, stem="porter2")


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_rounds_match_golden(sample, sample_words, rounds):
    vocab, words = sample_words
    m = M.fit(sample, words, vocab_size=2, iterations=rounds)
    p1 = [r.p_1 for r in m.q.orderBy("task_id").collect()]
    want, elbo = GOLDEN[rounds]
    assert p1 == pytest.approx(want, abs=1e-6)
    assert m.trace[-1][1] == pytest.approx(elbo, abs=1e-6)
    assert m.kappa == pytest.approx([3.0, 3.0])


def test_invariants(sample, sample_words):
    vocab, words = sample_words
    m = M.fit(sample, words, vocab_size=2, iterations=4)
    rows = m.q.collect()
    assert all(abs(r.p_0 + r.p_1 - 1) < 1e-12 for r in rows)
    elbos = [t[1] for t in m.trace]
    assert all(b >= a - 1e-9 for a, b in zip(elbos, elbos[1:]))
    assert sum(m.kappa) == pytest.approx(4 + 2)  # N tasks + C
    cm = m.worker_confusion()
    tot = cm.agg(F.sum("alpha")).first()[0]
    # prior mass 5 workers x (5.5 + 1) x 2 rows + one count per annotation
    assert tot == pytest.approx(5 * 6.5 * 2 + 20)
    means = cm.where("worker_id = '1'").orderBy("true_class", "label").collect()
    assert [round(r.mean, 4) for r in means[:2]] == [0.8722, 0.1278] or \
        [round(r.mean, 4) for r in means[:2]] == [0.8721, 0.1279]


def test_repartition_invariance(sample, sample_words):
    vocab, words = sample_words
    a = M.fit(sample, words, vocab_size=2, iterations=3, trace=False)
    b = M.fit(sample.repartition(7), words.repartition(3), vocab_size=2, iterations=3,
              trace=False)
    pa = sorted((r.task_id, r.p_1) for r in a.q.collect())
    pb = sorted((r.task_id, r.p_1) for r in b.q.collect())
    assert [x[1] for x in pa] == pytest.approx([x[1] for x in pb], abs=1e-9)
