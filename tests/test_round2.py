"""Cases that once gave a wrong or silent answer."""

import pytest
from pyspark.sql import functions as F

import crowdlens as cl
from crowdlens import session
from crowdlens.operators import mapping as MP
from crowdlens.operators import model as M
from crowdlens.operators import vocab as V
from crowdlens.streaming.scoring import score_texts
from tests.conftest import make_ann

WORDS = ["running dogs bark loudly", "cats sleeping quietly", "dogs running", "sleeping cats dream", "birds fly"]


def crowd(spark):
    return make_ann(spark, [(f"w{w}", f"t{t}", (t + (w == 2 and t == 3)) % 2, WORDS[t], t % 2)
                            for t in range(5) for w in range(3)])


def test_seeds_give_different_picks(spark):
    rows = spark.range(4000).select(F.col("id").alias("row_id"), (F.col("id") % 1000).cast("string").alias("task_id"),
                                    (F.col("id") / 1000).cast("int").alias("worker_label"))
    pick = {s: {r.task_id: r.assigned_label for r in MP.random_label(rows, s).collect()} for s in (1, 2)}
    same = sum(pick[1][t] == pick[2][t] for t in pick[1])
    assert 180 < same < 330  # one in four by chance


def test_partial_clamp_keeps_the_other_tasks(spark):
    clamp = spark.createDataFrame([("t0", 1), ("t0", 1)], "task_id string, label int")
    q = {r.task_id: r for r in M.fit(crowd(spark), None, iterations=4, clamp=clamp).q.collect()}
    assert len(q) == 5 and q["t0"].p_1 == 1.0 and q["t1"].p_1 > 0.5 > q["t2"].p_1


def test_words_need_the_vocabulary_size(spark):
    a = crowd(spark)
    words = V.task_words(a, V.vocabulary(a, stem="none"), stem="none")
    with pytest.raises(ValueError, match="vocab_size"):
        M.fit(a, words, iterations=1)


def test_labels_outside_the_domain_are_refused(spark):
    with pytest.raises(ValueError, match="domain"):
        M.fit(crowd(spark), None, iterations=1, domain=MP.LabelDomain(1, 2))


def test_fit_builds_a_vocabulary_and_scoring_uses_its_stemmer(spark):
    model = cl.fit(crowd(spark), iterations=3)
    assert model.word_alpha is not None and model.stem == "porter2"
    docs = spark.createDataFrame([(0, "run dog"), (1, "sleep cat")], "k int, text string")
    got = {r.k: r.p_0 for r in score_texts(model, model.vocab, docs, "k").collect()}
    assert abs(got[0] - got[1]) > 1e-6 or got[0] != 0.5


@pytest.mark.parametrize("classes", [1, 3])
def test_no_curve_beyond_two_classes(spark, classes):
    a = make_ann(spark, [(f"w{w}", f"t{t}", t % classes, WORDS[t], t % classes) for t in range(5) for w in range(2)])
    model = cl.fit(a, use_words=False, iterations=2)
    assert cl.evaluate(model, a).auc.first().auc is None


def test_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app"
        getConf = staticmethod(Conf)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        session.checkpoint_dir(Session())
    before = spark.sparkContext.getCheckpointDir()
    session.cut(spark.range(3))
    assert spark.sparkContext.getCheckpointDir() == before


def test_cut_restores_settings_and_release_deletes(spark):
    before = {k: spark.conf.get(k, None) for k in session.JOB_CONF}
    table = session.cut(spark.range(5))
    assert {k: spark.conf.get(k, None) for k in session.JOB_CONF} == before and table.count() == 5
    session.release(table)
    with pytest.raises(Exception):
        spark.read.parquet(table.written_to)
