"""Scans without a copy, rounds that are observed, journalled, shrunk and
stretched, exact AUC, mergeable profiles and published reports."""

import math
import random

import pytest
from pyspark.sql import functions as F

from crowdlens import manifest
from crowdlens.operators import evaluate as E
from crowdlens.operators import mapping as MP
from crowdlens.operators import model as M
from crowdlens.operators import ordering as O
from crowdlens.operators import profile as P
from crowdlens.operators import quality as Q
from crowdlens.operators import report as R
from crowdlens.operators import vocab as V
from crowdlens.plans import catalog
from crowdlens.session import cut, scratch_path
from crowdlens.sources import fixtures as FX
from crowdlens.sources import tsv as TSV
from tests.conftest import make_ann

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------ numbered scan


@pytest.fixture
def small_splits(spark):
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    for k, v in held.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_lines(tmp_path, files):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, lines in files.items():
        (folder / name).write_text("".join(x + "\n" for x in lines))
    return str(folder)


def test_lines_of_many_splits_are_numbered_in_order(spark, tmp_path, small_splits):
    rnd = random.Random(1)
    files = {f"f{i}.txt": [f"{i}:{j}:" + "x" * rnd.randrange(90) for j in range(rnd.choice([0, 1, 150]))] for i in range(6)}
    path = write_lines(tmp_path, files)
    lines = TSV.numbered_lines(spark, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")  # the plan was cut before and stays as it is
    want = [x for name in sorted(files) for x in files[name]]
    assert [r.value for r in lines.orderBy("line_no").collect()] == want
    assert [r.line_no for r in lines.orderBy("line_no").collect()] == list(range(1, len(want) + 1))
    assert lines.rdd.getNumPartitions() > 20  # as many splits as were counted


def test_a_scan_writes_a_row_a_split_and_not_its_lines(spark, tmp_path):
    def written(n):
        folder = tmp_path / f"n{n}"
        folder.mkdir()
        path = write_lines(folder, {"a.txt": [f"w{i % 7}\tt{i}\t{i % 2}\t" + "some text " * 20 for i in range(n)]})
        before = {x[0] for x in manifest.listing(spark, [TSV.cut(spark.range(1), "probe").written_to.rsplit("/", 1)[0]])}
        assert TSV.read_annotations(spark, path).count() == n
        root = TSV.cut(spark.range(1), "probe").written_to.rsplit("/", 1)[0]
        return sum(size for p, size, _ in manifest.listing(spark, [root])
                   if p not in before and ("/splits-" in p or "/offsets-" in p or "/lines-" in p)), path
    small, _ = written(10)
    large, _ = written(3000)
    assert 0 < large < 3 * small and large < 20_000


def test_lines_cut_in_another_way_are_an_error(spark, tmp_path):
    path = write_lines(tmp_path, {"a.txt": [f"line {i}" for i in range(50)]})
    lines = TSV._lines(spark, path)
    offsets = TSV.split_offsets(spark, lines)
    wrong = offsets.withColumn("_n", F.col("_n") - 1)
    with pytest.raises(Exception, match="cut in another way"):
        TSV._numbered(lines, wrong).collect()
    with pytest.raises(Exception, match="cut in another way"):
        TSV._numbered(lines, offsets.where("false")).collect()


def test_bad_lines_are_counted_in_the_counting_pass(spark, tmp_path):
    path = write_lines(tmp_path, {"a.txt": ["w\tt\t1\tok", "", "w\tt\tx\tbad", "w\tt", "w\tt\t1\tgold\t1.5", "w\tt\t1\tok\t "]})
    with pytest.warns(UserWarning, match="^3 lines"):
        assert TSV.read_annotations(spark, path).count() == 2


# ------------------------------------------------------------ positions


def test_positions_need_one_exchange(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"))
    got = O.dense_positions(rows, ["k"], "at")
    assert all(r.at == r.k for r in got.collect()) and got.count() == 500
    # what is left to do after the ranged rows are written: only the ranges are exchanged
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window [row_number" not in plan and "rangepartitioning" not in plan
    assert O.dense_positions(rows.limit(0), ["k"], "at").count() == 0


def test_running_sums_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randrange(5), rnd.randrange(9)) for i in rnd.sample(range(1000), 200)]
    got = O.running_sums(spark.createDataFrame(rows, "k int, a long, b long").repartition(5), ["k"], ["a", "b"])
    for r in got.collect():
        below = [x for x in rows if x[0] < r.k]
        assert (r.before_a, r.before_b) == (sum(x[1] for x in below), sum(x[2] for x in below))


# ------------------------------------------------------------ the fit


def crowd(spark, tasks=60, workers=6, seed=5, classes=2):
    rnd = random.Random(seed)
    truth = [rnd.randrange(classes) for _ in range(tasks)]
    skill = [0.95, 0.9, 0.8, 0.7, 0.6, 0.5][:workers]
    rows = []
    for t in range(tasks):
        for w in rnd.sample(range(workers), 4):
            label = truth[t] if rnd.random() < skill[w] else rnd.randrange(classes)
            rows.append((f"w{w}", f"t{t}", label, f"text {t}", truth[t] if t % 3 == 0 else None))
    return make_ann(spark, rows)


def posteriors(model):
    return {r.task_id: tuple(r)[1:] for r in model.q.select("task_id", *M.p_cols(model.classes)).collect()}


def near(a, b, tol):
    assert a.keys() == b.keys()
    assert max(abs(x - y) for k in a for x, y in zip(a[k], b[k])) <= tol


def with_words(spark, a):
    vocab = V.vocabulary(a, stem="none")
    return {"words": V.task_words(a, vocab, stem="none"), "vocab_size": vocab.count()}


def test_observed_bound_equals_the_posterior_tables(spark):
    a = crowd(spark, classes=3)
    m = M.fit(a, iterations=4, **with_words(spark, a))
    q = m.q.collect()
    ent = -sum(p * math.log(p) for r in q for p in (r.p_0, r.p_1, r.p_2) if p > 0)
    lg = math.lgamma
    want = ent + sum(map(lg, m.kappa)) - lg(sum(m.kappa)) + lg(3.0)
    rows = {}
    for r in m.worker_alpha.collect():
        rows.setdefault(r.worker_id, []).append(r)
        want += sum(lg(r[f"a_{t}"]) - lg(m.prior[t][r.label]) for t in range(3))
    want -= sum(lg(own[0][f"s_{t}"]) - lg(7.5) for own in rows.values() for t in range(3))
    want += sum(lg(r[f"a_{t}"]) for r in m.word_alpha.collect() for t in range(3))
    want -= sum(lg(m.word_totals[t]) - lg(m.vocab_size) for t in range(3))
    assert m.trace[-1][1] == pytest.approx(want, abs=1e-6)
    assert sum(m.kappa) == pytest.approx(len(q) + 3) and len(m.round_rows) == 4


def test_many_classes_take_the_window_form(spark, monkeypatch):
    a = crowd(spark, classes=3)
    wide = M.fit(a, iterations=3)
    monkeypatch.setattr(M, "WIDE_CLASSES", 2)
    tall = M.fit(a, iterations=3)
    near(posteriors(wide), posteriors(tall), 1e-9)
    assert [x[1] for x in wide.trace] == pytest.approx([x[1] for x in tall.trace], abs=1e-9)


def test_a_stopped_fit_goes_on_from_its_journal(spark, tmp_path, monkeypatch):
    a = crowd(spark)
    words = with_words(spark, a)
    straight = M.fit(a, iterations=6, **words)
    folder = str(tmp_path / "journal")
    store, calls = M._store_q, []

    def failing(*args):
        calls.append(1)
        if len(calls) == 4:
            raise RuntimeError("the driver is lost")
        return store(*args)

    monkeypatch.setattr(M, "_store_q", failing)
    with pytest.raises(RuntimeError):
        M.fit(a, iterations=6, journal=folder, **words)
    assert manifest.numbers(spark, folder) == [2, 3]  # the two newest whole rounds
    went_on = M.fit(a, iterations=6, journal=folder, **words)
    assert len(calls) == 7 and len(went_on.round_seconds) == 3  # rounds 4 to 6 only
    near(posteriors(straight), posteriors(went_on), 1e-12)
    assert [x[0] for x in went_on.trace] == list(range(1, 7))
    assert [x[1] for x in went_on.trace] == pytest.approx([x[1] for x in straight.trace], abs=1e-9)
    again = M.fit(a, iterations=6, journal=folder, **words)  # nothing left to do
    assert len(calls) == 7 and posteriors(again) == posteriors(went_on)
    with pytest.raises(ValueError, match="another fit"):
        M.fit(a.where("row_id > 3"), iterations=6, journal=folder, **words)


@pytest.mark.parametrize("split_rows", [1_000_000, 3])  # salted keys, too
def test_the_working_set_shrinks_and_the_result_does_not_change(spark, split_rows):
    a = crowd(spark, tasks=120)
    options = {"iterations": 14, "split_rows": split_rows, **with_words(spark, a)}
    plain, small = M.fit(a, **options), M.fit(a, shrink=1e-6, **options)
    near(posteriors(plain), posteriors(small), 1e-5)
    rows = small.round_rows
    assert rows[0] == rows[-1] == a.count() and min(rows) < rows[0] / 2  # the last round sweeps over all
    assert plain.round_rows == [a.count()] * 14
    assert plain.trace[-1][1] == pytest.approx(small.trace[-1][1], abs=1e-4)


def test_a_shrunk_fit_stops_only_after_a_sweep(spark):
    a = crowd(spark, tasks=120)
    m = M.fit(a, iterations=60, shrink=1e-5, tol=1e-4, trace=False)
    assert len(m.round_rows) < 60 and m.round_rows[-1] == a.count() and m.trace[-1][2] < 1e-4


@pytest.mark.parametrize("fixture", ["a", "b"])
def test_stretched_steps_need_fewer_rounds_and_the_bound_never_falls(spark, fixture):
    if fixture == "a":
        a = FX.text_annotations(spark, SF)
        options = with_words(spark, a)
    else:
        a, options = FX.order_annotations(spark, SF, with_text=False), {}
    a = cut(a)
    plain = M.fit(a, iterations=40, tol=1e-3, **options)
    fast = M.fit(a, iterations=40, tol=1e-3, accelerate=True, **options)
    bounds = [x[1] for x in fast.trace]
    assert all(y >= x - 1e-6 for x, y in zip(bounds, bounds[1:]))
    assert len(fast.trace) < len(plain.trace) and bounds[-1] >= plain.trace[-1][1] - 1e-2
    with pytest.raises(ValueError):
        M.fit(a, accelerate=True, shrink=1e-3)


# ------------------------------------------------------------ exact AUC


def brute_auc(rows):
    pos = [s for g, s in rows if g == max(g for g, _ in rows)]
    neg = [s for g, s in rows if g != max(g for g, _ in rows)]
    v = [sum((s > x) + (s == x) / 2 for x in neg) / len(neg) for s in pos]
    w = [sum((x > s) + (s == x) / 2 for x in pos) / len(pos) for s in neg]
    auc = sum(v) / len(v)
    var = lambda xs: sum((x - auc) ** 2 for x in xs) / (len(xs) - 1)
    return auc, math.sqrt(var(v) / len(v) + var(w) / len(w))


@pytest.mark.parametrize("seed", range(3))
def test_exact_auc_equals_all_pairs(spark, seed):
    rnd = random.Random(seed)
    rows = [(g, rnd.choice([1.0, 0.0, 0.5, round(rnd.random() * (1 + g) / 2, rnd.choice([1, 8]))]))
            for g in (rnd.randrange(2) for _ in range(150))] + [(1, 0.99999)] * 80  # tied posteriors
    pred = spark.createDataFrame([(g, p, p if g else 1 - p) for g, p in rows], "gold int, p_1 double, p_gold double")
    got = E.rank_auc(pred.repartition(4)).first()
    auc, se = brute_auc(rows)
    assert (got.auc, got.auc_se) == (pytest.approx(auc, abs=1e-12), pytest.approx(se, abs=1e-9))
    assert (got.n_pos, got.n_neg) == (sum(g for g, _ in rows), sum(1 - g for g, _ in rows))


def test_exact_auc_without_negatives_or_rows(spark):
    kind = "gold int, p_1 double, p_gold double"
    for rows in ([], [(0, 0.5, 0.5)]):
        got = E.rank_auc(spark.createDataFrame(rows, kind)).first()
        assert (got.auc, got.auc_se, got.n_neg) == (None, None, 0)


# ------------------------------------------------------------ profile


def test_merged_profiles_equal_the_whole(spark):
    rows = [(w, t, lab, "x", g) for w, t, lab, g in [
        ("a", "1", 0, None), ("a", "2", 1, 1), (None, "2", 1, None), (" ", "3", 2, 0), ("b", None, None, None),
        ("b", "1", 0, 1)] for _ in range(2)]
    a = make_ann(spark, rows)
    whole = P.profile(P.state(a)).first()
    assert tuple(whole) == (12, 3, 3, 6, 0, 2)
    parts = [P.state(a.where(F.col("row_id") % 3 == i)) for i in range(3)]
    assert P.profile(P.merged(*parts)).first() == whole
    assert sorted(Q.dataset_issues_of(P.merged(*parts)).collect()) == sorted(Q.dataset_issues(a).collect())
    empty = P.profile(P.state(a.limit(0))).first()
    assert (empty.n_rows, empty.n_workers, empty.label_min) == (0, 0, None)


def test_the_profile_reads_its_input_once_and_expands_nothing(spark):
    b = FX.order_annotations(spark, SF, with_text=False)
    for df in (MP.dataset_profile(b), Q.summary(b)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Expand" not in plan and plan.count("l_orderkey") and plan.count("lineitem") + plan.count("Relation") <= 4
        assert df._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 2  # lineitem and orders


def test_sketches_merge_and_stay_near(spark):
    a = spark.range(30_000).select(F.concat(F.lit("w"), F.col("id") % 700).alias("worker_id"),
                                   F.concat(F.lit("t"), F.col("id") / 2).cast("string").alias("task_id"), "id")
    whole = P.sketched(P.distinct_sketches(a, F.lit(0))).first()
    parts = cut(P.distinct_sketches(a, F.col("id") % 7))
    got = P.sketched(parts).first()
    assert tuple(got) == tuple(whole) and parts.count() == 7
    assert abs(got.n_workers - 700) <= 21 and abs(got.n_tasks - 30_000) <= 900
    assert tuple(P.sketched(parts.limit(0)).first()) == (0, 0, 0)


def test_votes_and_gold_without_a_domain_equal_those_with_one(spark):
    a = crowd(spark, classes=3).withColumn("worker_label", F.col("worker_label") + 4).withColumn(
        "gold_label", F.col("gold_label") + 4)
    dom = MP.label_domain(a)
    for one, two in ((MP.majority_vote(a, zero_based=True), MP.majority_vote(a, dom)),
                     (MP.gold_per_task(a), MP.gold_per_task(a, dom))):
        assert sorted(one.collect()) == sorted(two.collect()) and one.count() > 10


# ------------------------------------------------------------ reports, memo


def test_a_failed_publication_leaves_the_old_reports(spark, tmp_path):
    folder = str(tmp_path / "reports")
    one = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    bad = one.select("k", F.raise_error(F.lit("lost")).cast("string").alias("v"))
    assert R.publish({"x": one, "y": one}, folder, orders={"x": ["k"], "y": ["-k"]}) == 1
    with pytest.raises(Exception, match="lost"):
        R.publish({"x": one.limit(0), "y": bad}, folder)
    assert [r.k for r in R.read_published(spark, folder, "x").collect()] == [1, 2]
    assert [r.k for r in R.read_published(spark, folder, "y").collect()] == [2, 1]
    kept = R.read_published(spark, folder, "x")
    R.publish({"x": one.limit(1)}, folder, fmt="csv")
    assert kept.count() == 2 and R.read_published(spark, folder, "x").count() == 1  # readers keep their version
    with pytest.raises(FileNotFoundError):
        R.read_published(spark, folder, "y")
    R.publish({"x": one}, folder)
    assert manifest.numbers(spark, folder) == [2, 3]
    with pytest.raises(FileExistsError):
        manifest.write(spark, folder, 3, {})
    assert manifest.read(spark, str(tmp_path / "nothing")) is None


def test_a_changed_table_is_read_again(spark, tmp_path):
    path = str(tmp_path / "labels.parquet")
    builds = []
    build = lambda: builds.append(1) or len(builds)
    spark.range(3).write.parquet(path)
    assert [catalog._memo(spark, str(tmp_path), ("k",), build) for _ in range(2)] == [1, 1]
    spark.range(5).write.mode("overwrite").parquet(path)
    assert catalog._memo(spark, str(tmp_path), ("k",), build) == 2


def test_norms_by_document_need_one_exchange(spark):
    """The weights are read from a table bucketed by document: only the small idf
    table is exchanged (broadcast), the norms are summed where the rows lie."""
    stats = V.term_stats(FX.document_rows(spark, SF), stem="none")
    df = V.tfidf_l2(stats)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Bucketed: true" in plan
    norms = df.groupBy("doc_order").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert len(norms) > 100 and all(r.n == pytest.approx(1.0) for r in norms)


def test_optional_modules_are_told_from_broken_ones(monkeypatch):
    import __spark_entry__ as entry

    assert entry._optional("corpus_pipeline_that_is_not_there") is None

    def broken(name):
        raise ModuleNotFoundError("x", name="crowdlens.llm.common" if name == "a" else "numpy")

    monkeypatch.setattr(entry, "import_module", broken)
    for name in ("a", "b"):
        with pytest.raises(ModuleNotFoundError):
            entry._optional(name)
