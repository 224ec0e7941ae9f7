import crowdlens as cl
from crowdlens.sources.fixtures import text_annotations


def test_facade_end_to_end(spark):
    ann = text_annotations(spark, "/root/testdata/sf0.001")
    v = cl.validate(ann)
    assert v.summary.first().total_records == ann.count()
    vocab = cl.build_vocabulary(ann, max_terms=50)
    model = cl.fit(ann, vocab, iterations=2)
    ev = cl.evaluate(model, ann)
    auc = ev.auc.first()
    assert 0.0 <= auc.auc <= 1.0 and auc.n_pos + auc.n_neg == ev.predictions.count()
    assert ev.roc.count() == 1001
    words = cl.word_ranking(model, vocab, k=5)
    assert words.count() == 2 * 5
    assert cl.worker_matrices(model, ann).count() == 5 * 2
    scored = cl.score_text(model, vocab, ann.select("task_id", "body_text").distinct(),
                           "task_id", text_col="body_text", stem="porter2")
    assert scored.select("task_id").distinct().count() == ann.select("task_id").distinct().count()
