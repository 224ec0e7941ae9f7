"""Bayesian label aggregation with worker confusion matrices and words.

Generative model: class prior kappa ~ Dir; true class t_n ~ kappa; worker k's
row pi_{k,c} ~ Dir; each label of k on n ~ pi_{k,t_n}; word distribution
phi_c ~ Dir; each distinct vocabulary word of task n ~ phi_{t_n}.  Fitted
by mean-field variational Bayes (coordinate ascent), one Spark job chain per
round:

    E   s_nc = E ln kappa_c + sum_{(k,l) on n} E ln pi_kcl + sum_{w in n} E ln phi_cw
        q_n  = softmax(s_n)
    M   kappa_c  = 1 + sum_n q_nc
        pi_kcl   = prior_cl + sum_{annotations of k with label l} q_nc
        phi_cw   = 1 + sum_{n containing w} q_nc

with E ln of a Dirichlet component = digamma(a_i) - digamma(sum a).

Spark shape per round: the E-step is a join of the annotations with the
(worker, label) table and of task words with the word table, then grouped
sums by task; the M-step is the annotations joined with q and grouped sums
by (worker, label) and by word.  Classes are C columns, so the joins stay
one row per annotation.  On the bucketed layout the (worker, label) and word
tables are dealt to the buckets that hold their keys, so no round sends a table
through the driver, however small.  Without it they are broadcast only when their
sizes (rows counted at fit start, times their columns) are under
``broadcast_bytes``; otherwise they are shuffle-joined, and workers or words
with over ``split_rows`` rows take their table rows by broadcast.

Layout: the annotations and task words are written once as tables bucketed
by task, and q is written bucketed the same way every round, so the E-step
sums and the M-step joins without moving the annotations.  If some tasks have
over ``split_rows`` annotations, the bucket key is (task, salt) and each such
task gets one salt per ``split_rows`` of them.  Every round's tables live in
the shared checkpoint folder, so lineage stays one round deep and a lost
executor only re-runs the current round; tables that no later round reads are
deleted.  Totals and bounds are observed where the tables are written.  Options
of ``fit`` shrink the working set, stretch the steps and keep a journal from
which a stopped fit goes on.
"""

from __future__ import annotations

import functools
import json
import math
import time
import uuid
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType

from crowdlens import manifest
from crowdlens.functions.special import digamma, lgamma
from crowdlens.operators.blocks import block_round
from crowdlens.operators.joins import BROADCAST_BYTES, SPLIT_ROWS, hot_keys, small, split_join
from crowdlens.operators.layout import bucketed as _bucketed
from crowdlens.operators.layout import forget as _forget
from crowdlens.operators.mapping import LabelDomain
from crowdlens.operators.rounds import BLOCK_ROWS, SLICE_KEYS, Packed, parameters, posteriors, run_round
from crowdlens.session import cut, release

DIAG_PRIOR = 5.5   # fixed value: prior pseudo-count for a correct label
OFF_PRIOR = 1.0    # fixed value: prior pseudo-count for a wrong label
CLASS_PRIOR = 1.0  # fixed value: uniform prior of the class proportions
WORD_PRIOR = 1.0   # fixed value: symmetric prior of the word distributions
ITERATIONS = 35    # fixed value: default number of rounds


def p_cols(c: int, prefix: str = "p_") -> list[str]:
    return [f"{prefix}{i}" for i in range(c)]


def confusion_prior(c: int, worker_prior: str = "biased",
                    belief: float = 0.7) -> list[list[float]]:
    """M3 (``biased``: 5.5 on the diagonal, 1 elsewhere) or M4 (``belief``:
    b/(1-b)*(C-1) on the diagonal, 1 elsewhere)."""
    if worker_prior == "biased":
        diag = DIAG_PRIOR
    elif worker_prior == "belief":
        diag = belief / (1.0 - belief) * (c - 1)
    else:
        raise ValueError(f"unknown worker prior {worker_prior!r}")
    return [[diag if l == t else OFF_PRIOR for l in range(c)] for t in range(c)]


def _prior_col(label: Column, true_class: int, prior: list[list[float]]) -> Column:
    expr = F.lit(prior[true_class][0])
    for l in range(1, len(prior)):
        expr = F.when(label == F.lit(l), F.lit(prior[true_class][l])).otherwise(expr)
    return expr


@dataclass
class CrowdModel:
    """Posterior tables of a fit (canonical long forms of the blueprint)."""

    domain: LabelDomain
    q: DataFrame                 # task_id, p_0..p_{C-1}
    worker_alpha: DataFrame      # worker_id, label, a_0..a_{C-1} (observed pairs)
    worker_rows: DataFrame       # worker_id, s_0..s_{C-1} (row sums over labels)
    kappa: list[float]           # class prior pseudo-counts
    word_alpha: DataFrame | None  # word_idx, a_0..a_{C-1} (words seen in some task)
    vocab_size: int
    word_totals: list[float] | None
    prior: list[list[float]]
    trace: list[tuple[int, float | None, float | None]] = field(default_factory=list)
    round_seconds: list[float] = field(default_factory=list)
    round_rows: list[int] = field(default_factory=list)  # annotations of the working set

    @property
    def classes(self) -> int:
        return self.domain.count

    # -- public tables -------------------------------------------------
    def class_prior(self) -> DataFrame:
        spark = self.q.sparkSession
        return spark.createDataFrame(
            [(c, float(a)) for c, a in enumerate(self.kappa)],
            "true_class int, alpha double")

    def worker_confusion(self) -> DataFrame:
        """``worker_id, true_class, label, alpha, mean`` for all C x C cells."""
        c = self.classes
        workers = self.worker_rows.select("worker_id", *p_cols(c, "s_"))
        grid = workers.withColumn("label", F.explode(F.sequence(F.lit(0), F.lit(c - 1))))
        obs = self.worker_alpha.select("worker_id", "label", *p_cols(c, "a_"))
        full = grid.join(obs, ["worker_id", "label"], "left")
        cells = []
        for t in range(c):
            alpha = F.coalesce(F.col(f"a_{t}"), _prior_col(F.col("label"), t, self.prior))
            cells.append(F.struct(F.lit(t).alias("true_class"), alpha.alias("alpha"),
                                  (alpha / F.col(f"s_{t}")).alias("mean")))
        return (full.select("worker_id", "label", F.explode(F.array(*cells)).alias("x"))
                .select("worker_id", F.col("x.true_class").alias("true_class"),
                        F.col("label").cast("int").alias("label"),
                        F.col("x.alpha").alias("alpha"), F.col("x.mean").alias("mean")))

    def word_log_prob(self, vocab: DataFrame) -> DataFrame:
        """``true_class, word_idx, term, alpha, log_prob`` = ln(alpha / sum alpha)."""
        if self.word_alpha is None:
            raise ValueError("the model was fitted without words")
        c = self.classes
        full = vocab.join(self.word_alpha, "word_idx", "left")
        cells = []
        for t in range(c):
            alpha = F.coalesce(F.col(f"a_{t}"), F.lit(WORD_PRIOR))
            cells.append(F.struct(F.lit(t).alias("true_class"), alpha.alias("alpha"),
                                  F.log(alpha / F.lit(self.word_totals[t])).alias("log_prob")))
        return (full.select("word_idx", "term", F.explode(F.array(*cells)).alias("x"))
                .select(F.col("x.true_class").alias("true_class"), "word_idx", "term",
                        F.col("x.alpha").alias("alpha"), F.col("x.log_prob").alias("log_prob")))

    def trace_df(self) -> DataFrame:
        spark = self.q.sparkSession
        return spark.createDataFrame(self.trace, "iteration int, elbo double, max_delta double")

    def evidence(self) -> DataFrame:
        """The bound of the last round as log-odds and probability."""
        spark = self.q.sparkSession
        elbo = self.trace[-1][1] if self.trace else None
        prob = None if elbo is None else 1.0 / (1.0 + math.exp(-elbo)) if elbo > -700 else 0.0
        return spark.createDataFrame([(elbo, prob)], "log_odds double, prob double")


# ----------------------------------------------------------------------
# Expectations of log parameters
# ----------------------------------------------------------------------

def _elog_kappa(kappa: list[float]) -> list[float]:
    total = sum(kappa)
    return [_digamma_py(a) - _digamma_py(total) for a in kappa]


def _digamma_py(x: float) -> float:
    shift = 0.0
    while x < 8.0:
        shift -= 1.0 / x
        x += 1.0
    inv2 = 1.0 / (x * x)
    return shift + (math.log(x) - 0.5 / x - inv2 * (1.0 / 12 - inv2 * (
        1.0 / 120 - inv2 * (1.0 / 252 - inv2 * (1.0 / 240 - inv2 / 132)))))


def _elog_phi(word_alpha: DataFrame, totals: list[float], c: int) -> DataFrame:
    return word_alpha.select("word_idx", *_held(word_alpha), *[
        (digamma(F.col(f"a_{t}")) - F.lit(_digamma_py(totals[t]))).alias(f"e_{t}")
        for t in range(c)])


def _softmax(scores: DataFrame, c: int) -> DataFrame:
    s = [F.col(f"e_{t}") for t in range(c)]
    m = F.greatest(*s) if c > 1 else s[0]
    ex = [F.exp(x - m) for x in s]
    z = ex[0]
    for e in ex[1:]:
        z = z + e
    return scores.select(*[x for x in ("block", "task_id", "n") if x in scores.columns],
                         *[(ex[t] / z).alias(f"p_{t}") for t in range(c)])


# ----------------------------------------------------------------------
# Fit
# ----------------------------------------------------------------------

@dataclass
class _Inputs:
    ann: DataFrame          # task_id, worker_id, label (and salt)
    words: DataFrame | None  # task_id, word_idx (and salt)
    keys: list[str]         # (block and) task_id, with salt if some task is hot
    salts: DataFrame | None  # task_id, salts of the hot tasks
    buckets: int | None     # bucket count when annotations are co-located with q
    blocks: DataFrame | None  # block, bit: one block a bucket
    numbers: list[int]      # block by bucket
    hash_join: bool         # q of one bucket is small enough for a hash table
    hot_workers: DataFrame | None  # read only if the tables are too large to broadcast
    hot_words: DataFrame | None
    word_only: bool         # some tasks have words but no annotation
    bc_pairs: bool
    bc_words: bool
    vocab_size: int
    n_rows: int             # annotations of the working set
    whole_keys: bool        # no null task, worker or label
    hash_pairs: bool = False  # a block's share of the (worker, label) table is small enough for a hash table
    hash_words: bool = False
    packed: DataFrame | None = None  # block, task, key: the rows of a block as numbers
    n_pairs: int = 0        # (worker, label) pairs, about


# Every block gets the parameters of its keys and gives partial sums of them: what
# crosses the network in a round is blocks x keys, so blocks are few and large.
ROWS_PER_BUCKET = 12_000_000
HASH_ROWS = 4_000_000  # rows of a block up to which a table (q, parameters) is hashed, not sorted
ROUND_BYTES = 2 << 20  # without blocks, a parameter table up to this goes through the driver every round
MASK_BITS = 63         # blocks beyond it share bits: a key may then reach a block that lacks it


def _bucket_count(spark, n_rows: int) -> int:
    """Buckets for the co-located layout: one per ``ROWS_PER_BUCKET`` annotations,
    at least the task slots, at most what the session allows in one table."""
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    return min(most, max(spark.sparkContext.defaultParallelism, n_rows // ROWS_PER_BUCKET + 1))


def _block_numbers(spark, buckets: int) -> list[int]:
    """A number for every bucket that Spark's hash deals into it."""
    rows = spark.range(0, 64 * buckets, numPartitions=1).select(F.col("id").cast("int").alias("v")) \
        .groupBy(_slot(F.col("v"), buckets).alias("s")).agg(F.min("v").alias("v")).collect()
    found = {r["s"]: r["v"] for r in rows}
    return [found.get(i, i) for i in range(buckets)]


def _slot(block: Column, buckets: int) -> Column:
    return F.pmod(F.hash(block), F.lit(buckets))


def _block_of(cols: list[str], numbers: list[int]) -> Column:
    """The block of a task (and salt)."""
    at = F.pmod(F.xxhash64(*cols), F.lit(len(numbers))).cast("int")
    return F.element_at(F.lit(numbers), at + 1)


def _bit(inp_buckets: int) -> Column:
    """The bit of the row's block in the masks of keys."""
    return F.expr(f"shiftleft(1L, pmod(hash(block), {inp_buckets}) % {MASK_BITS})")


def _where(inp: _Inputs, broadcast: bool) -> list[Column]:
    """An aggregate: the blocks in which a key occurs.  Not kept where the table is broadcast."""
    return [] if broadcast or inp.blocks is None else [F.bit_or("at").alias("at")]


def _marked(rows: DataFrame, inp: _Inputs) -> DataFrame:
    return rows if inp.blocks is None else rows.withColumn("at", _bit(inp.buckets))


def _held(table: DataFrame) -> list[str]:
    return ["at"] if "at" in table.columns else []


def _at_blocks(params: DataFrame, inp: _Inputs, hashed: bool) -> DataFrame:
    """The rows of a parameter table, dealt to every block that has their key: no
    table passes through the driver, and the annotations stay where they are."""
    dealt = params.join(F.broadcast(inp.blocks), F.expr("(at & bit) != 0")).drop("at", "bit") \
        .repartition(inp.buckets, "block")
    return dealt.hint("shuffle_hash") if hashed else dealt


def _prepare(ann: DataFrame, domain: LabelDomain | None, words: DataFrame | None,
             vocab_size: int | None, split_rows: int, buckets: int | None, broadcast_bytes: int,
             marked: bool = False) -> tuple[_Inputs, LabelDomain, dict]:
    """The inputs as the rounds read them, the label domain and, if ``marked``, a
    mark of the data by which a journal knows it."""
    raw = cut(ann.select("task_id", "worker_id", "row_id", "worker_label"), "annotations")
    stats = raw.agg(F.count(F.lit(1)).alias("n"),
                    F.approx_count_distinct(F.struct("worker_id", "worker_label")).alias("pairs"),
                    F.approx_count_distinct("task_id").alias("tasks"),
                    F.count_if(F.col("task_id").isNull() | F.col("worker_id").isNull()
                               | F.col("worker_label").isNull()).alias("gaps"),
                    F.min("worker_label").alias("lo"), F.max("worker_label").alias("hi")).first()
    mark = {}
    if marked:
        mark = {"rows": stats["n"], "annotations": _checksum(raw, ["task_id", "worker_id", "worker_label"]),
                "words": None if words is None else _checksum(words, ["task_id", "word_idx"]), "vocab_size": vocab_size}
    if domain is None:
        if stats["lo"] is None:
            raise ValueError("no annotations: the label domain is undefined")
        domain = LabelDomain(int(stats["lo"]), int(stats["hi"]))
    if stats["lo"] is not None and (stats["lo"] < domain.label_min
                                    or stats["hi"] >= domain.label_min + domain.count):
        raise ValueError("annotations with a label outside the given domain")
    c, v = domain.count, int(vocab_size or 0)
    a = raw.select("task_id", "worker_id", "row_id",
                   (F.col("worker_label") - F.lit(domain.label_min)).cast("int").alias("label"))
    a = a.where((F.col("label") >= 0) & (F.col("label") < c))
    bc_pairs = int(stats["pairs"]) * (64 + 16 * c) <= broadcast_bytes
    bc_words = v * (24 + 8 * c) <= broadcast_bytes
    hot = hot_keys(a, "task_id", split_rows)
    keys, salts = ["task_id"], None
    if hot is not None:
        keys = ["task_id", "salt"]
        salts = small(cut(hot.select("task_id", F.ceil(F.col("n") / F.lit(split_rows)).cast("int").alias("salts")),
                          "salts"))
        a = a.join(salts, "task_id", "left").withColumn(
            "salt", F.pmod(F.xxhash64("row_id", "worker_id"), F.coalesce("salts", F.lit(1))).cast("int"))
    a = a.select("task_id", "worker_id", "label", *keys[1:])
    spark = ann.sparkSession
    n_rows = int(stats["n"])
    blocks, numbers = None, []
    if buckets == 0:
        buckets = _bucket_count(spark, n_rows)
    if buckets is not None:
        try:
            numbers = _block_numbers(spark, buckets)
            placed = _bucketed(a.withColumn("block", _block_of(keys, numbers)), ["block"], buckets, "annotations")
            keys = ["block", *keys]
            blocks = spark.range(1).select(F.explode(F.lit(numbers)).alias("block")).withColumn("bit", _bit(buckets))
        except AnalysisException:  # no writable catalog, found before anything is written
            buckets = None
    if blocks is not None:  # a broadcast in every round takes whole memory pages even for a few rows
        bc_pairs = bc_words = False
    else:
        # spread evenly over the task slots so every round's scan is parallel
        placed = cut(a.repartition(spark.sparkContext.defaultParallelism), "annotations")
    release(raw)
    hot_workers = None if bc_pairs or blocks is not None else hot_keys(placed, "worker_id", split_rows)
    hash_join = int(stats["tasks"]) <= HASH_ROWS * (buckets or 0)
    w = hot_words = None
    word_only = False
    if words is not None:
        w = words.select("task_id", F.col("word_idx").cast("bigint").alias("word_idx"),
                         *[F.lit(0).alias(x) for x in keys if x == "salt"])  # meets q's salt-0 row exactly once
        if buckets is not None:
            w = _bucketed(w.withColumn("block", _block_of(keys[1:], numbers)), ["block"], buckets, "task_words")
        else:
            w = cut(w.repartition(spark.sparkContext.defaultParallelism), "task-words")
        hot_words = None if bc_words or blocks is not None else hot_keys(w, "word_idx", split_rows)
        word_only = not _unlabelled(w, placed, keys, hash_join).isEmpty()
    return _Inputs(placed, w, keys, salts, buckets, blocks, numbers, hash_join, hot_workers,
                   hot_words, word_only, bc_pairs, bc_words, v, n_rows, stats["gaps"] == 0,
                   n_pairs=int(stats["pairs"])), domain, mark


def _unlabelled(words: DataFrame, ann: DataFrame, keys: list[str], hashed: bool) -> DataFrame:
    """The words of tasks without annotation; in blocks they are found where they lie."""
    tasks = ann.select(*keys).distinct()
    if "block" in keys:  # by its file size Spark would broadcast it
        tasks = tasks.hint("shuffle_hash" if hashed else "shuffle_merge")
    return words.join(tasks, keys, "left_anti")


def _checksum(rows: DataFrame, cols: list[str]) -> int:
    """A sum over the rows that does not depend on their order."""
    return int(rows.agg(F.sum(F.pmod(F.xxhash64(*cols), F.lit(1_000_003)))).first()[0] or 0)


def _by_block(run):
    """Tables dealt by block join on (block, task) and the like as they lie, and rows
    written in order of their block are not sorted again; restored as ``run`` ends."""
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false",
              "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}

    @functools.wraps(run)
    def held(ann: DataFrame, *args, **options):
        conf = ann.sparkSession.conf
        before = {name: conf.get(name, None) for name in wanted}
        for name, value in wanted.items():
            conf.set(name, value)
        try:
            return run(ann, *args, **options)
        finally:
            for name, value in before.items():
                conf.unset(name) if value is None else conf.set(name, value)
    return held


@_by_block
def fit(ann: DataFrame, words: DataFrame | None = None, vocab_size: int | None = None,
        iterations: int = ITERATIONS, domain: LabelDomain | None = None,
        worker_prior: str = "biased", belief: float = 0.7, tol: float | None = None,
        trace: bool = True, clamp: DataFrame | None = None,
        broadcast_bytes: int = ROUND_BYTES, split_rows: int = SPLIT_ROWS,
        co_locate: bool = True, buckets: int | None = None, shrink: float | None = None,
        accelerate: bool = False, journal: str | None = None) -> CrowdModel:
    """M1/M5: fit the model for ``iterations`` rounds (or until the largest
    change of any task posterior is below ``tol``).

    ``words``: ``(task_id, word_idx)`` distinct pairs; None fits the
    labels-only model (M10).  ``clamp``: ``(task_id, label)`` fixes the true
    class of those tasks (M8).  Returns the posterior tables.

    ``co_locate``: store the annotations bucketed by task once and write q
    bucketed the same way every round, so neither the E-step sum nor the
    annotation-q join moves the annotations.  ``buckets`` defaults to one per
    task slot or, if that is more, per 12,000,000 annotations; the (worker, label) and
    word tables are dealt to the buckets that hold their keys by a shuffle.
    ``broadcast_bytes``: without buckets, tables above it are shuffled.  ``split_rows``: annotations of one task (worker, word)
    that may meet in one task; beyond it the key is split.

    Jobs per round: write q, write the (worker, label) table, write the word
    table.  Class totals, entropy, the largest change of q and the terms of the
    bound are observed by the tasks that write them, so nothing is read again.

    ``shrink``: tasks whose posterior moved less than this in a round may be set
    aside: when they are half of the working set, their share of every sum is kept
    as a table, the working set is written anew without them, and later rounds read
    only that.  The last round, or the one after ``tol`` is met or nothing is left,
    sweeps over all tasks again; the fit goes on with all of them if any moved by
    ``tol`` or more.  What stood still for many rounds is off by some times
    ``shrink``: take it well below the accuracy that is wanted.

    ``accelerate``: after two plain rounds, whose changes tell how fast the steps
    become smaller, a round starts from parameters stretched along the last step to
    where the steps would lead.  A round that ends with a lower bound is dropped and
    the plain step taken instead, so the bound never falls.

    ``journal``: a shared folder in which every round leaves its tables and, last,
    a manifest.  A fit of the same data and options that finds one there goes on
    after its newest whole round.
    """
    if words is not None and not vocab_size:
        raise ValueError("words need vocab_size, the number of vocabulary terms")
    if shrink is not None and accelerate:
        raise ValueError("a working set that shrinks cannot be combined with stretched steps")
    inp, domain, mark = _prepare(ann, domain, words, vocab_size, split_rows,
                                 (buckets or 0) if co_locate else None, broadcast_bytes, journal is not None)
    whole = inp
    c = domain.count
    prior = confusion_prior(c, worker_prior, belief)
    plain = not accelerate and tol is None and shrink is None and journal is None
    if plain and words is not None and clamp is None and iterations > 0 and _numbers_fit(inp, c):
        return _fit_numbered(inp, domain, prior, iterations, trace)

    clamp_q = None
    if clamp is not None:
        clamp = clamp.groupBy("task_id").agg(F.min("label").alias("label"))
        clamp_q = cut(clamp.select("task_id", *[
            F.when(F.col("label") == t, 1.0).otherwise(0.0).alias(f"p_{t}")
            for t in range(c)]), "clamp")
    part_q = None  # fixed classes of some tasks only: the others go on being estimated
    if clamp_q is not None and not inp.ann.join(clamp_q, "task_id", "left_anti").isEmpty():
        part_q, clamp_q = clamp_q, None
        if inp.blocks is not None and inp.salts is None:  # joined with q where q lies
            part_q = _bucketed(part_q.withColumn("block", _block_of(["task_id"], inp.numbers)), ["block"], inp.buckets,
                               "clamp")

    log = None if journal is None else _Journal(ann.sparkSession, journal, {
        **mark, "label_min": domain.label_min, "prior": prior, "clamped": clamp is not None})
    history: list[tuple[int, float | None, float | None]] = []
    seconds: list[float] = []
    rows: list[int] = []
    done, prev, stored, bound = 0, None, None, None
    packing = clamp_q is None and plain and words is None and not trace and _packs(inp, c)
    if packing:  # every block gets its parameters dealt
        inp = replace(inp, bc_pairs=False, bc_words=False)
    held = None
    if log is not None:
        held, iterations = log.newest(iterations)
    if held is None:
        good = _first_params(inp, prior, c)
    else:
        done, good, stored, history, bound = held
        good = _placed_anew(inp, good)
    if clamp_q is not None:
        iterations = min(iterations, 1)  # nothing changes between rounds when every class is fixed
    if inp.blocks is not None:
        inp = whole = _hashed(inp, good)
    if packing and done < iterations:
        inp = whole = replace(inp, packed=_packed(inp, good, c, part_q))
    # q of the round before, and what it is joined by (a journal may come from a session with other blocks)
    before, before_on = stored, [x for x in inp.keys if x != "block"]
    stretch, steps, frozen, spent, closing = 1.0, [], None, None, False

    # q is written where something reads it again; else the M-step sums it as it comes
    passing = (inp.blocks is not None and inp.salts is None and inp.whole_keys and not inp.word_only
               and inp.words is None and clamp_q is None and not (trace or accelerate) and tol is None and shrink is None)

    def retire(*tables: DataFrame | None) -> None:  # a journal deletes the files that it names itself
        for table in tables:
            _forget(table, log is None)

    for it in range(done + 1, iterations + 1):
        started = time.time()
        where = None if log is None else log.folder_of(it)
        if frozen is not None and (closing or it == iterations):  # sweep over all tasks
            before, before_on = frozen.with_rest(before, c), ["task_id"]
            _forget(inp.ann)
            _forget(inp.words)
            inp, frozen, spent, closing = whole, None, frozen, False
        # ---------------- E-step: one grouped sum by task ----------------
        start = _stretched(prev, good, stretch, prior, inp, c) if stretch > 1 else good
        wanted = (trace or tol is not None or shrink is not None or accelerate) and (
            before if inp.packed is None else prev) is not None
        if inp.packed is not None:
            fresh, on = _block_sums(inp, start, prev if wanted else None, c, shrink or 0.0), inp.keys
        elif clamp_q is not None:
            fresh, on = clamp_q, ["task_id"]
            fresh.observed = clamp_q.agg(*[F.sum(f"p_{t}").alias(f"k_{t}") for t in range(c)]).first().asDict()
        elif passing and it < iterations:
            fresh, on = _posterior(inp, start, c, part_q, counted=True), inp.keys
        else:
            fresh = _store_q(_posterior(inp, start, c, part_q), inp, before if wanted else None, before_on, c,
                             shrink, where)
            on = inp.keys  # both sides bucketed by the keys: joined without exchange
        # ---------------- M-step: grouped sums of q ----------------
        new, elbo = _m_step(inp, fresh, on, prior, c, frozen, trace or accelerate, where)
        seen = getattr(fresh, "observed", {})
        if inp.packed is not None:
            seen, fresh = new.worker.observed, None
            if it == iterations or (shrink is not None and it < iterations - 1 and 2 * seen["calm"] >= seen["tasks"] > 0):
                aside = it < iterations  # how far each task moved is written with its posterior
                fresh = _store_q(_posterior(inp, start, c, part_q), inp, _posterior(inp, prev, c, part_q) if aside else None,
                                 inp.keys, c, shrink if aside else None, where)
                seen = {**seen, **fresh.observed} if aside else seen
        elif not hasattr(fresh, "written_to") and clamp_q is None:
            fresh = None
        delta = float(seen["delta"] or 0.0) if wanted and clamp_q is None else None
        dropped = stretch > 1 and elbo < bound - 1e-12 * abs(bound)  # beyond rounding
        if dropped:  # too far: the next round takes the plain step from the same parameters
            for table in (fresh, new.worker, new.word):
                _forget(table)
            stretch, steps, delta = 1.0, [], None
        else:
            if prev is not None:
                retire(prev.worker, prev.word)
            if clamp_q is None:
                retire(stored)
            prev, good, bound, stored = good, new, elbo, fresh
            before, before_on = (stored, inp.keys) if clamp_q is None else (None, None)
            steps = [*steps[-1:], delta] if stretch == 1 and delta else []
            stretch = 1.0
            if accelerate and len(steps) == 2:  # steps that shrink by r add up to 1 / (1 - r) of the last one
                stretch = 1 / (1 - min(steps[1] / steps[0], 1 - 1 / MAX_STRETCH))
        if spent is not None:
            for table in (spent.worker, spent.word, *spent.q):
                _forget(table)
            spent = None
        history.append((it, bound if trace else None, delta))
        if log is not None and not dropped and clamp_q is None:
            log.commit(it, good, stored, history, bound)
        seconds.append(time.time() - started)
        rows.append(inp.n_rows)
        if tol is not None and delta is not None and delta < tol:
            if frozen is None:
                break
            closing = True  # the tasks that were set aside are looked at once more
        elif shrink is not None and not closing and it < iterations - 1 and 2 * seen["calm"] >= seen["tasks"] > 0 \
                and stored is not None:
            smaller, frozen = _set_aside(inp, stored, frozen, shrink, c)
            if inp.packed is not None:  # its rows are those of all tasks
                _forget(inp.packed)
                smaller, whole = replace(smaller, packed=None), replace(whole, packed=None)
                inp = whole
            if inp is not whole:
                _forget(inp.ann)
                _forget(inp.words)
            inp, before = smaller, stored.where(F.col("_d") >= F.lit(shrink))
            closing = inp.n_rows == 0  # nothing moves any more: look at all tasks again
    if prev is not None:
        retire(prev.worker, prev.word)
    for used in {id(x): x for x in (inp.ann, inp.words, whole.ann, whole.words, whole.packed)}.values():
        _forget(used)
    q = _plain(stored).drop("_d", "block")
    worker, word = good.worker.drop("at"), None if good.word is None else good.word.drop("at")
    return CrowdModel(domain, q, worker, worker_rows(worker, prior, c), good.kappa, word, whole.vocab_size, good.word_totals, prior, history, seconds, rows)


def _fit_numbered(inp: _Inputs, domain: LabelDomain, prior: list[list[float]], iterations: int,
                  trace: bool) -> CrowdModel:
    """The rounds of a fit with words on numbers (see ``rounds``)."""
    spark, c = inp.ann.sparkSession, domain.count
    ann, words, blocks = inp.ann, inp.words, inp.buckets
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    wanted = min(most, (inp.n_rows + words.count()) // BLOCK_ROWS + 1)
    if wanted > blocks:
        blocks, numbers = wanted, _block_numbers(spark, wanted)
        ann, words = (x.withColumn("block", _block_of(["task_id"], numbers)) for x in (ann, words))
    slices = _block_numbers(spark, min(most, max(spark.sparkContext.defaultParallelism,
                                                 (inp.vocab_size + inp.n_pairs) // SLICE_KEYS + 1)))
    packed = Packed(ann, words, c, blocks, slices, _block_of, HASH_ROWS)
    _forget(inp.ann)
    _forget(inp.words)
    kappa, totals = [CLASS_PRIOR] * c, [WORD_PRIOR * inp.vocab_size] * c
    sent = run_round(packed, None, None, prior, WORD_PRIOR, False, False)
    history, seconds = [], []
    for it in range(1, iterations + 1):
        started, last, before = time.time(), it == iterations, sent
        logs = _elog_kappa(kappa), [_digamma_py(x) for x in totals]
        sent = run_round(packed, before, logs, prior, WORD_PRIOR, trace or last, last)
        release(before)
        seen = sent.observed
        kappa = [CLASS_PRIOR + seen[f"k_{t}"] for t in range(c)]
        totals = [WORD_PRIOR * inp.vocab_size + seen[f"w_{t}"] for t in range(c)]
        elbo = seen["entropy"] + _kappa_bound(kappa) + seen["bound"] + seen["cells"] - sum(
            math.lgamma(x) - math.lgamma(WORD_PRIOR * inp.vocab_size) for x in totals)
        history.append((it, elbo if trace else None, seen["delta"] if trace and it > 1 else None))
        seconds.append(time.time() - started)
    q, (worker, word) = posteriors(packed, sent), parameters(packed, sent)
    release(sent)
    packed.forget()
    return CrowdModel(domain, q, worker, worker_rows(worker, prior, c), kappa, word, inp.vocab_size, totals, prior,
                      history, seconds, [inp.n_rows] * iterations)


@dataclass
class _Params:
    """Parameter tables: kappa, worker rows (worker_id, label, a_*, s_*), words
    (word_idx, a_*) and their totals."""

    kappa: list[float]
    worker: DataFrame
    word: DataFrame | None = None
    word_totals: list[float] | None = None


def _first_params(inp: _Inputs, prior: list[list[float]], c: int) -> _Params:
    """The priors: kappa = 1, pi = prior, phi = 1."""
    pairs = _marked(inp.ann, inp).groupBy("worker_id", "label").agg(*_where(inp, inp.bc_pairs) or [F.count(F.lit(1))])
    # a worker's labels go where the worker goes, as in the tables of the rounds
    worker = cut(pairs.select(
        "worker_id", "label", *[F.bit_or(x).over(Window.partitionBy("worker_id")).alias(x) for x in _held(pairs)],
        *[_prior_col(F.col("label"), t, prior).alias(f"a_{t}") for t in range(c)],
        *[F.lit(sum(prior[t])).alias(f"s_{t}") for t in range(c)]), "worker-alpha")
    if inp.words is None:
        return _Params([CLASS_PRIOR] * c, worker)
    words = _marked(inp.words, inp).groupBy("word_idx").agg(*_where(inp, inp.bc_words) or [F.count(F.lit(1))])
    word = cut(words.select(
        "word_idx", *_held(words), *[F.lit(WORD_PRIOR).alias(f"a_{t}") for t in range(c)]), "word-alpha")
    return _Params([CLASS_PRIOR] * c, worker, word, [WORD_PRIOR * inp.vocab_size] * c)


def _placed_anew(inp: _Inputs, held: _Params) -> _Params:
    """Parameters of a journal with the blocks of this session."""
    def placed(table: DataFrame | None, rows: DataFrame | None, key: list[str], broadcast: bool) -> DataFrame | None:
        if table is None or broadcast or inp.blocks is None:
            return table
        at = _marked(rows, inp).groupBy(*key).agg(*_where(inp, False))
        same = F.lit(True)
        for k in key:
            same = same & F.col(f"t.{k}").eqNullSafe(F.col(f"n.{k}"))
        new = cut(table.drop("at").alias("t").join(at.alias("n"), same, "left").select("t.*", "n.at"), "placed")
        new.written_to = table.written_to  # the journal's files are deleted by the journal
        return new

    return replace(held, worker=placed(held.worker, inp.ann, ["worker_id", "label"], inp.bc_pairs),
                   word=placed(held.word, inp.words, ["word_idx"], inp.bc_words))


def _hashed(inp: _Inputs, first: _Params) -> _Inputs:
    """Which parameter tables are hashed in the blocks, by the rows that a block gets."""
    def fits(table: DataFrame | None) -> bool:
        if table is None or not _held(table):
            return False
        return int(table.agg(F.sum(F.bit_count("at"))).first()[0] or 0) <= HASH_ROWS * min(inp.buckets, MASK_BITS)

    return replace(inp, hash_pairs=fits(first.worker), hash_words=fits(first.word))


MAX_STRETCH = 12.0  # longest step, in lengths of the last one


def _stretched(old: _Params, new: _Params, by: float, prior: list[list[float]], inp: _Inputs, c: int) -> _Params:
    """``old`` + by * (``new`` - ``old``), kept above half of the priors.  It is only
    where the next round starts from: any positive parameters will do."""
    def step(n: Column, o: Column, least) -> Column:
        return F.greatest(n + F.lit(by - 1) * (n - o), least)

    def numbers(n: list[float], o: list[float], least: float) -> list[float]:
        return [max(x + (by - 1) * (x - y), least) for x, y in zip(n, o)]

    def both(n: DataFrame, o: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
        return n.join(o.select(*key, *[F.col(x).alias(f"o{x}") for x in cols]), key)

    cols = [*p_cols(c, "a_"), *p_cols(c, "s_")]
    worker = both(new.worker, old.worker, ["worker_id", "label"], cols).select(
        "worker_id", "label", *_held(new.worker),
        *[step(F.col(f"a_{t}"), F.col(f"oa_{t}"), _prior_col(F.col("label"), t, prior) / 2).alias(f"a_{t}")
          for t in range(c)],
        *[step(F.col(f"s_{t}"), F.col(f"os_{t}"), F.lit(sum(prior[t]) / 2)).alias(f"s_{t}") for t in range(c)])
    kappa = numbers(new.kappa, old.kappa, CLASS_PRIOR / 2)
    if new.word is None:
        return _Params(kappa, worker)
    word = both(new.word, old.word, ["word_idx"], p_cols(c, "a_")).select("word_idx", *_held(new.word), *[
        step(F.col(f"a_{t}"), F.col(f"oa_{t}"), F.lit(WORD_PRIOR / 2)).alias(f"a_{t}") for t in range(c)])
    return _Params(kappa, worker, word, numbers(new.word_totals, old.word_totals, WORD_PRIOR * inp.vocab_size / 2))


def _posterior(inp: _Inputs, start: _Params, c: int, part_q: DataFrame | None, counted: bool = False) -> DataFrame:
    """The E-step: ``task_id, p_*`` (and block; ``counted``: the annotations, ``n``) of the working set."""
    epi = start.worker.select("worker_id", "label", *_held(start.worker), *[
        (digamma(F.col(f"a_{t}")) - digamma(F.col(f"s_{t}"))).alias(f"e_{t}")
        for t in range(c)])
    if inp.bc_pairs:
        scores = inp.ann.join(F.broadcast(epi), ["worker_id", "label"])
    elif inp.blocks is not None:
        scores = inp.ann.join(_at_blocks(epi, inp, inp.hash_pairs), ["block", "worker_id", "label"])
    else:
        scores = split_join(inp.ann, epi, ["worker_id", "label"], inp.hot_workers)
    ws = None
    if inp.words is not None:
        ephi = _elog_phi(start.word, start.word_totals, c)
        if inp.bc_words:
            ws = inp.words.join(F.broadcast(ephi), "word_idx")
        elif inp.blocks is not None:
            ws = inp.words.join(_at_blocks(ephi, inp, inp.hash_words), ["block", "word_idx"])
        else:
            ws = split_join(inp.words, ephi, ["word_idx"], inp.hot_words)
    ek = _elog_kappa(start.kappa)
    summed = _summed(scores, ws, inp, c, counted)
    keys = [x for x in ("block", "task_id", "n") if x in summed.columns]
    q = _softmax(summed.select(*keys, *[
        (F.col(f"e_{t}") + F.lit(ek[t])).alias(f"e_{t}") for t in range(c)]), c)
    if part_q is not None:
        on = [x for x in keys if x in part_q.columns]
        fixed = part_q.select(*on, *[F.col(f"p_{t}").alias(f"f_{t}") for t in range(c)])
        q = q.join(fixed, on, "left").select(*keys, *[
            F.coalesce(f"f_{t}", f"p_{t}").alias(f"p_{t}") for t in range(c)])
    return q


def _packs(inp: _Inputs, c: int) -> bool:
    """Whether the rounds can run on numbered rows dealt by masks: few enough blocks for these."""
    return _numbers_fit(inp, c) and inp.buckets <= MASK_BITS


def _numbers_fit(inp: _Inputs, c: int) -> bool:
    """Whether the rounds can run on numbered rows: no hot task, no null key, few classes."""
    return (inp.blocks is not None and inp.salts is None and inp.whole_keys and not inp.word_only and c <= WIDE_CLASSES
            and isinstance(inp.ann.schema["worker_id"].dataType, (StringType, IntegerType, LongType))
            and (inp.words is None or inp.words.where(F.col("word_idx").isNull()).isEmpty()))


def _packed(inp: _Inputs, first: _Params, c: int, part_q: DataFrame | None) -> DataFrame:
    """The rows of every block as numbers (``block, task, key``, see ``blocks``), bucketed by
    block, with the class of tasks whose class is given as ``fixed``."""
    tasks = _bucketed(inp.ann.select("block", "task_id").distinct().withColumn(
        "task", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("int")), ["block"], inp.buckets, "tasks")
    names, given = tasks, []
    if part_q is not None:
        code = F.lit(c)
        for t in range(c):
            code = F.when(F.col(f"p_{t}") == 1.0, F.lit(t)).otherwise(code)
        on = [x for x in ("block", "task_id") if x in part_q.columns]
        names = tasks.join(part_q.select(*on, code.alias("fixed")), on, "left").fillna(-1, ["fixed"])
        given = ["fixed"]
    names = names.hint("shuffle_hash") if inp.hash_join else names

    def numbered(rows: DataFrame, table: DataFrame, key: list[str], hashed: bool, number: Column) -> DataFrame:
        dealt = _at_blocks(table.select(*key, "at"), inp, False).select("block", *key, F.row_number().over(
            Window.partitionBy("block").orderBy(*key)).alias("_n"))
        return (rows.join(names, ["block", "task_id"]).join(dealt.hint("shuffle_hash") if hashed else dealt, ["block", *key])
                .select("block", "task", number.cast("int").alias("key"), *given))

    rows = numbered(inp.ann, first.worker, ["worker_id", "label"], inp.hash_pairs, F.col("_n") - 1)
    if inp.words is not None:
        rows = rows.unionByName(numbered(inp.words, first.word, ["word_idx"], inp.hash_words, -F.col("_n")))
    packed = _bucketed(rows, ["block"], inp.buckets, "packed", ordered=True)
    _forget(tasks)
    return packed


def _block_sums(inp: _Inputs, start: _Params, older: _Params | None, c: int, calm: float) -> DataFrame:
    """E- and M-step inside the blocks: sums of the posteriors by the keys of each block
    and, in one row of a block, its totals.  No row of a task leaves its block."""
    kind = inp.ann.schema["worker_id"].dataType.simpleString()

    def logs(params: _Params, old: bool) -> DataFrame:
        out = params.worker.select("worker_id", "label", F.lit(None).cast("bigint").alias("word_idx"), "at", *[
            (digamma(F.col(f"a_{t}")) - digamma(F.col(f"s_{t}"))).alias(f"e_{t}") for t in range(c)])
        if params.word is not None:
            out = out.unionByName(params.word.select(
                F.lit(None).cast(kind).alias("worker_id"), F.lit(0).alias("label"), "word_idx", "at",
                *[digamma(F.col(f"a_{t}")).alias(f"e_{t}") for t in range(c)]))
        return out.withColumn("old", F.lit(old))

    def totals(params: _Params | None) -> tuple[list[float], list[float]] | None:
        return params and (_elog_kappa(params.kappa), [_digamma_py(x) for x in params.word_totals or [1.0] * c])

    params = logs(start, False) if older is None else logs(start, False).unionByName(logs(older, True))
    stats = [*[f"k_{t}" for t in range(c)], *STATS]
    schema = (f"worker_id {kind}, label int, word_idx bigint, block int, "
              + ", ".join(f"{x} double" for x in [*p_cols(c), *stats]))
    return inp.packed.groupBy("block").cogroup(_at_blocks(params, inp, False).groupBy("block")).applyInArrow(
        block_round(c, totals(start), totals(older), calm), schema)


STATS = ("entropy", "delta", "calm", "tasks")  # of a block, beside its class totals


def _entropy(c: int) -> Column:
    return sum((F.when(F.col(f"p_{t}") > 0, -F.col(f"p_{t}") * F.log(F.col(f"p_{t}")))
                .otherwise(0.0) for t in range(c)), F.lit(0.0))


def _store_q(q: DataFrame, inp: _Inputs, before: DataFrame | None, on: list[str], c: int,
             shrink: float | None, where: str | None) -> DataFrame:
    """Writes q as the inputs are laid out.  Class totals, entropy, the largest
    change against ``before`` and the number of tasks that moved less than
    ``shrink`` are observed on the way; with ``shrink`` the change stays as ``_d``."""
    q = _salted(q, inp)
    if before is not None:
        old = before.select(*on, *[F.col(f"p_{t}").alias(f"o_{t}") for t in range(c)])
        q = q.join(old.hint("shuffle_hash") if inp.hash_join and on == inp.keys else old, on, "left")
        moved = F.greatest(*[F.abs(F.col(f"p_{t}") - F.coalesce(f"o_{t}", F.lit(-1.0))) for t in range(c)], F.lit(0.0))
        q = q.withColumn("_d", moved)
    else:
        q = q.withColumn("_d", F.lit(1.0))
    q = q.select(*inp.keys, *p_cols(c), "_d")
    once = F.col("salt") == 0 if "salt" in inp.keys else F.lit(True)  # hot tasks have a row for every salt
    metrics = {**{f"k_{t}": F.sum(F.when(once, F.col(f"p_{t}"))) for t in range(c)},
               "entropy": F.sum(F.when(once, _entropy(c))), "delta": F.max("_d"), "tasks": F.count_if(once),
               "calm": F.count_if(once & (F.col("_d") < F.lit(shrink or 0.0)))}
    hidden = [] if shrink is not None else ["_d"]
    path = None if where is None else f"{where}/q"
    if inp.buckets is not None:
        return _bucketed(q, ["block"], inp.buckets, "q", metrics, hidden, path)
    return cut(q, "q", metrics, path, hidden)


def _m_step(inp: _Inputs, q: DataFrame, on: list[str], prior: list[list[float]], c: int,
            frozen: _Frozen | None, bounded: bool, where: str | None) -> tuple[_Params, float | None]:
    """The parameters that go with ``q`` (and the tasks set aside), and the bound."""
    packed = inp.packed is not None
    at_rows = q.hint("shuffle_hash") if inp.hash_join and on == inp.keys and not packed else q
    worker = _worker_table(inp, at_rows, on, prior, c, frozen, bounded, where)
    seen = worker.observed if packed or "n" in q.columns else q.observed
    base = frozen.totals if frozen is not None else [0.0] * c
    new = _Params([CLASS_PRIOR + float(seen[f"k_{t}"] or 0.0) + base[t] for t in range(c)], worker)
    if packed and inp.words is not None:  # one table of both
        pair = F.col("word_idx").isNull()
        new.worker = worker.where(pair).drop("word_idx")
        new.word = worker.where(~pair).select("word_idx", "at", *p_cols(c, "a_"))
        for table in (new.worker, new.word):
            table.written_to, table.observed = worker.written_to, seen
        new.word_totals = [WORD_PRIOR * inp.vocab_size + float(seen[f"w_{t}"] or 0.0) for t in range(c)]
    elif inp.words is not None:
        where_at = _where(inp, inp.bc_words)
        sums = _marked(inp.words.join(at_rows, on), inp).select("word_idx", *["at"] * len(where_at), *p_cols(c))
        if frozen is not None:
            sums = sums.unionByName(frozen.word)
        gain = {f"w_{t}": F.sum(F.col(f"a_{t}") - F.lit(WORD_PRIOR)) for t in range(c)}
        gain["cells"] = F.sum(sum((lgamma(F.col(f"a_{t}")) - F.lit(math.lgamma(WORD_PRIOR))
                                   for t in range(c)), F.lit(0.0)))
        new.word = cut(sums.groupBy("word_idx").agg(*[
            (F.sum(f"p_{t}") + F.lit(WORD_PRIOR)).alias(f"a_{t}") for t in range(c)], *where_at),
            "word-alpha", gain, None if where is None else f"{where}/word")
        new.word_totals = [WORD_PRIOR * inp.vocab_size + float(new.word.observed[f"w_{t}"] or 0.0) for t in range(c)]
    if not bounded:
        return new, None
    elbo = float(seen.get("entropy") or 0.0) + (frozen.entropy if frozen is not None else 0.0)
    elbo += _kappa_bound(new.kappa) + float(worker.observed["bound"] or 0.0)
    if inp.words is not None:
        elbo += float(new.word.observed["cells"] or 0.0) - sum(
            math.lgamma(x) - math.lgamma(WORD_PRIOR * inp.vocab_size) for x in new.word_totals)
    return new, elbo


WIDE_CLASSES = 8  # classes up to which a worker's whole matrix is one aggregated row


def _worker_table(inp: _Inputs, at_rows: DataFrame, on: list[str], prior: list[list[float]], c: int,
                  frozen: _Frozen | None, bounded: bool, where: str | None) -> DataFrame:
    """``worker_id, label, a_*, s_*`` of the observed pairs.  For few classes a
    worker's sums of all labels are one row, so row sums need no second exchange;
    else they are a window over at most C rows of a worker.  Sums that come from
    packed blocks hold those of the words, too (``word_idx``)."""
    where_at = _where(inp, inp.bc_pairs)
    at = ["at"] * len(where_at)
    by, own, metrics = ["worker_id"], F.lit(True), {}
    if inp.packed is not None:
        shares = [*[f"k_{t}" for t in range(c)], *STATS]
        if inp.words is not None:
            by, own = ["worker_id", "word_idx"], F.col("word_idx").isNull()
        rows = _marked(at_rows, inp).select("label", *by, *at, *p_cols(c), *shares)
    else:
        # q that is not written: every annotation has its share of the class totals of its task
        shares = [f"k_{t}" for t in range(c)] if "n" in at_rows.columns else []
        rows = _marked(inp.ann.join(at_rows, on), inp).select(
            "worker_id", "label", *at, *p_cols(c), *[(F.col(f"p_{k[2:]}") / F.col("n")).alias(k) for k in shares])
    if frozen is not None:
        rows = rows.unionByName(frozen.worker)
    row0 = [sum(prior[t]) for t in range(c)]
    label = F.col("label")
    if c <= WIDE_CLASSES:
        wide = rows.groupBy(*by).agg(*[
            F.sum(F.when(label == l, F.col(f"p_{t}"))).alias(f"n_{l}_{t}") for l in range(c) for t in range(c)],
            *where_at, *[(F.max(k) if k == "delta" else F.sum(k)).alias(k) for k in shares])
        total = [sum((F.coalesce(f"n_{l}_{t}", F.lit(0.0)) for l in range(c)), F.lit(row0[t])) for t in range(c)]

        def least(t: int, l: int) -> Column:
            return F.lit(prior[t][l]) if len(by) == 1 else F.when(own, prior[t][l]).otherwise(WORD_PRIOR)

        cells = F.array_compact(F.array(*[F.when(F.col(f"n_{l}_0").isNotNull(), F.struct(
            F.lit(l).alias("label"), *[(F.col(f"n_{l}_{t}") + least(t, l)).alias(f"a_{t}") for t in range(c)]))
            for l in range(c)]))
        table = wide.select(*by, *at, *shares, *[F.when(own, total[t]).alias(f"s_{t}") for t in range(c)],
                            F.posexplode(cells).alias("_at", "_x"))
        table = table.select(*by, *at, *shares, "_x.*", *p_cols(c, "s_"), (F.col("_at") == 0).alias("_lead"))
    else:
        counts = rows.groupBy("worker_id", "label").agg(*[
            (F.sum(f"p_{t}") + F.first(_prior_col(label, t, prior))).alias(f"a_{t}") for t in range(c)],
            *where_at, *[F.sum(k).alias(k) for k in shares])
        per_worker = Window.partitionBy("worker_id")
        table = counts.select("worker_id", "label", *at, *[F.sum(k).over(per_worker).alias(k) for k in shares],
                              *p_cols(c, "a_"), *[
            (F.sum(F.col(f"a_{t}") - _prior_col(label, t, prior)).over(per_worker) + F.lit(row0[t])).alias(f"s_{t}")
            for t in range(c)], (F.row_number().over(per_worker.orderBy("label")) == 1).alias("_lead"))
    # ln B(alpha_kc) - ln B(prior_c) over workers and true classes; the row sums count once a worker
    lg_prior = [[math.lgamma(p) for p in row] for row in prior]
    pairs = sum((lgamma(F.col(f"a_{t}")) - _prior_col(label, t, lg_prior) for t in range(c)), F.lit(0.0))
    sums = sum((lgamma(F.col(f"s_{t}")) - F.lit(math.lgamma(row0[t])) for t in range(c)), F.lit(0.0))
    if bounded:
        metrics["bound"] = F.sum(F.when(own, pairs - F.when(F.col("_lead"), sums).otherwise(0.0)))
    if len(by) > 1:
        gain = [F.col(f"a_{t}") - F.lit(WORD_PRIOR) for t in range(c)]
        metrics.update({f"w_{t}": F.sum(F.when(~own, gain[t])) for t in range(c)})
        metrics["cells"] = F.sum(F.when(~own, sum((lgamma(F.col(f"a_{t}")) - F.lit(math.lgamma(WORD_PRIOR))
                                                   for t in range(c)), F.lit(0.0))))
    metrics.update({k: (F.max if k == "delta" else F.sum)(F.when(F.col("_lead"), F.col(k))) for k in shares})
    return cut(table.select(*by, "label", *at, *p_cols(c, "a_"), *p_cols(c, "s_"), "_lead", *shares),
               "worker-alpha", metrics, None if where is None else f"{where}/worker", ["_lead", *shares])


@dataclass
class _Frozen:
    """What the tasks that were set aside add to the sums of a round."""

    worker: DataFrame            # worker_id, label, p_*
    word: DataFrame | None       # word_idx, p_*
    totals: list[float]          # by class
    entropy: float
    q: list[DataFrame]           # task_id, p_*

    def with_rest(self, rest: DataFrame, c: int) -> DataFrame:
        out = _plain(rest).select("task_id", *p_cols(c))
        for part in self.q:
            out = out.unionByName(part)
        return out


def _set_aside(inp: _Inputs, stored: DataFrame, frozen: _Frozen | None, shrink: float,
               c: int) -> tuple[_Inputs, _Frozen]:
    """The working set without the tasks that moved less than ``shrink``, written
    anew, and their sums added to those of the tasks set aside before."""
    calm = stored.where(F.col("_d") < F.lit(shrink))
    rest = stored.where(F.col("_d") >= F.lit(shrink)).select(*inp.keys)
    q = cut(_plain(calm).select("task_id", *p_cols(c)), "set-aside", {
        **{f"k_{t}": F.sum(f"p_{t}") for t in range(c)}, "entropy": F.sum(_entropy(c))})

    def sums(rows: DataFrame, by: list[str], held: DataFrame | None, broadcast: bool) -> DataFrame:
        where_at = _where(inp, broadcast)
        found = _marked(rows.join(calm.select(*inp.keys, *p_cols(c)), inp.keys), inp).select(
            *by, *["at"] * len(where_at), *p_cols(c))
        found = found if held is None else found.unionByName(held)
        return cut(found.groupBy(*by).agg(*[F.sum(f"p_{t}").alias(f"p_{t}") for t in range(c)], *where_at), "base")

    def left(rows: DataFrame, name: str) -> DataFrame:
        kept = rows.join(rest, inp.keys, "left_semi")
        metrics = {"rows": F.count(F.lit(1))}
        return (_bucketed(kept, ["block"], inp.buckets, name, metrics) if inp.buckets is not None
                else cut(kept.repartition(rows.sparkSession.sparkContext.defaultParallelism), name, metrics))

    worker = sums(inp.ann, ["worker_id", "label"], frozen.worker if frozen else None, inp.bc_pairs)
    word = None if inp.words is None else sums(inp.words, ["word_idx"], frozen.word if frozen else None, inp.bc_words)
    ann = left(inp.ann, "annotations")
    words = None if inp.words is None else left(inp.words, "task_words")
    if frozen is not None:
        _forget(frozen.worker)
        _forget(frozen.word)
    totals = [float(q.observed[f"k_{t}"] or 0.0) + (frozen.totals[t] if frozen else 0.0) for t in range(c)]
    entropy = float(q.observed["entropy"] or 0.0) + (frozen.entropy if frozen else 0.0)
    return (replace(inp, ann=ann, words=words, n_rows=int(ann.observed["rows"])),
            _Frozen(worker, word, totals, entropy, [*(frozen.q if frozen else []), q]))


class _Journal:
    """Rounds of a fit in a shared folder: tables under a folder of each round and
    attempt, then a manifest that names them.  The two newest rounds are kept."""

    def __init__(self, spark, folder: str, mark: dict):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.mark, self.attempt = json.loads(json.dumps(mark)), uuid.uuid4().hex[:8]

    def folder_of(self, it: int) -> str:
        return f"{self.folder}/round-{it:06d}-{self.attempt}"

    def newest(self, iterations: int):
        """(round, parameters, q, history, bound) of the newest whole round, and the
        round to stop at.  A round that did not write its q cannot be the last one: it
        is taken again from the round before it."""
        held = manifest.read(self.spark, self.folder)
        if held is not None and "q" not in held["tables"] and held["round"] >= iterations:
            iterations = held["round"]
            older = manifest.numbers(self.spark, self.folder)[:-1]
            self._known(held)
            manifest.forget(self.spark, self.folder, held["round"])
            for path in held["tables"].values():
                manifest.delete(self.spark, path)
            held = manifest.read(self.spark, self.folder, older[-1]) if older else None
        if held is None:
            return None, iterations
        self._known(held)
        tables = {name: self.spark.read.parquet(path) for name, path in held["tables"].items()}
        for name, table in tables.items():
            table.written_to = held["tables"][name]
        return (held["round"], _Params(held["kappa"], tables["worker"], tables.get("word"), held["word_totals"]),
                tables.get("q"), [tuple(x) for x in held["history"]], held["bound"]), iterations

    def _known(self, held: dict) -> None:
        if held["mark"] != self.mark:
            raise ValueError(f"the journal in {self.folder} belongs to another fit")

    def commit(self, it: int, good: _Params, q: DataFrame, history: list, bound: float | None) -> None:
        tables = {**({"q": q} if q is not None else {}), "worker": good.worker, **({"word": good.word} if good.word is not None else {})}
        manifest.write(self.spark, self.folder, it, {
            "mark": self.mark, "round": it, "tables": {k: t.written_to for k, t in tables.items()},
            "kappa": good.kappa, "word_totals": good.word_totals, "history": history, "bound": bound})
        for old in manifest.numbers(self.spark, self.folder)[:-2]:
            for path in manifest.read(self.spark, self.folder, old)["tables"].values():
                manifest.delete(self.spark, path)
            manifest.forget(self.spark, self.folder, old)


def _summed(scores: DataFrame, ws: DataFrame | None, inp: _Inputs, c: int, counted: bool = False) -> DataFrame:
    """Scores of annotations and words summed by task.  On the bucketed layout
    both are summed and joined where they lie; with hot tasks the sums by salt
    are exchanged once more."""
    def sums(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.sum(f"e_{t}").alias(f"e_{t}") for t in range(c)])

    if inp.buckets is not None and inp.salts is None:
        own = sums(scores, inp.keys) if not counted else scores.groupBy(*inp.keys).agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(f"e_{t}").alias(f"e_{t}") for t in range(c)])
        if ws is None:
            return own
        more = sums(ws, inp.keys).select(*inp.keys, *[F.col(f"e_{t}").alias(f"w_{t}") for t in range(c)])
        zero = F.lit(0.0)
        return own.join(more, inp.keys, "full_outer" if inp.word_only else "left").select(*inp.keys, *["n"] * counted, *[
            (F.coalesce(f"e_{t}", zero) + F.coalesce(f"w_{t}", zero)).alias(f"e_{t}") for t in range(c)])
    cols = ["task_id", *p_cols(c, "e_")]
    parts = [sums(x, inp.keys) if inp.buckets is not None else x for x in (scores, ws) if x is not None]
    both = parts[0].select(*cols) if len(parts) == 1 else parts[0].select(*cols).unionByName(parts[1].select(*cols))
    return sums(both, ["task_id"])


def _salted(q: DataFrame, inp: _Inputs) -> DataFrame:
    """q with a row for every salt of the hot tasks (salt 0 for the others)."""
    if inp.salts is None:
        return q
    last = F.coalesce(F.col("salts"), F.lit(1)) - 1
    q = (q.join(inp.salts, "task_id", "left")
         .withColumn("salt", F.explode(F.sequence(F.lit(0), last))).drop("salts"))
    return q if inp.blocks is None else q.withColumn("block", _block_of(["task_id", "salt"], inp.numbers))


def _plain(stored: DataFrame) -> DataFrame:
    return stored.where(F.col("salt") == 0).drop("salt") if "salt" in stored.columns else stored


def worker_rows(worker_alpha: DataFrame, prior: list[list[float]], c: int) -> DataFrame:
    """Row sums over labels of each worker's matrix: the prior row total
    plus the counts of the observed labels (unobserved cells hold the prior)."""
    row0 = [sum(prior[t]) for t in range(c)]
    return worker_alpha.groupBy("worker_id").agg(*[
        (F.sum(F.col(f"a_{t}") - _prior_col(F.col("label"), t, prior)) + F.lit(row0[t]))
        .alias(f"s_{t}") for t in range(c)])


def _kappa_bound(kappa: list[float]) -> float:
    lg = math.lgamma
    c = len(kappa)
    return (sum(lg(a) for a in kappa) - lg(sum(kappa))
            - (c * lg(CLASS_PRIOR) - lg(c * CLASS_PRIOR)))


# ----------------------------------------------------------------------
# Uses of a fitted model
# ----------------------------------------------------------------------

def predicted_class(c: int, digits: int = 9) -> Column:
    """Arg-max class; ties (after rounding to ``digits``) go to the lowest class."""
    best = F.lit(0)
    best_p = F.round(F.col("p_0"), digits)
    for t in range(1, c):
        p = F.round(F.col(f"p_{t}"), digits)
        best = F.when(p > best_p, F.lit(t)).otherwise(best)
        best_p = F.greatest(best_p, p)
    return best.cast("int")


def score_text(model: CrowdModel, keys: DataFrame, doc_words: DataFrame,
               key: str) -> DataFrame:
    """Class posterior of unlabelled texts from the word model alone:
    softmax(E ln kappa + sum over distinct vocabulary words E ln phi).
    ``keys``: one row per text; ``doc_words``: distinct ``(key, word_idx)``.
    Texts without vocabulary words get the class prior."""
    c = model.classes
    ephi = _elog_phi(model.word_alpha, model.word_totals, c)
    unseen = [_digamma_py(WORD_PRIOR) - _digamma_py(model.word_totals[t]) for t in range(c)]
    ek = _elog_kappa(model.kappa)
    if model.vocab_size * (24 + 8 * c) <= BROADCAST_BYTES:
        scored = doc_words.join(F.broadcast(ephi), "word_idx", "left")
    else:
        doc_words = cut(doc_words, "doc-words")
        seen = doc_words.join(ephi.select("word_idx"), "word_idx", "left_anti")  # words of no task
        scored = split_join(doc_words, ephi, ["word_idx"], hot_keys(doc_words, "word_idx")) \
            .unionByName(seen, allowMissingColumns=True)
    j = keys.select(key).distinct().join(scored, key, "left")
    summed = j.groupBy(key).agg(*[
        (F.sum(F.when(F.col("word_idx").isNull(), F.lit(0.0))
               .otherwise(F.coalesce(F.col(f"e_{t}"), F.lit(unseen[t]))))
         + F.lit(ek[t])).alias(f"e_{t}") for t in range(c)])
    return _softmax(summed.withColumnRenamed(key, "task_id"), c).withColumnRenamed("task_id", key)


def worker_prediction(model: CrowdModel, pairs: DataFrame) -> DataFrame:
    """p(label l from worker k on task n) = sum_c q_nc * E[pi_kcl].

    ``pairs``: ``(worker_id, task_id)``.  One row per pair and label."""
    c = model.classes
    obs = model.worker_alpha.select("worker_id", "label", *p_cols(c, "a_"))
    conf = (model.worker_rows.withColumn("label", F.explode(F.sequence(F.lit(0), F.lit(c - 1))))
            .join(obs, ["worker_id", "label"], "left")
            .select("worker_id", "label", *[
                (F.coalesce(F.col(f"a_{t}"), _prior_col(F.col("label"), t, model.prior)) / F.col(f"s_{t}"))
                .alias(f"m_{t}") for t in range(c)]))
    j = pairs.join(model.q, "task_id").join(conf, "worker_id")
    prob = sum((F.col(f"p_{t}") * F.col(f"m_{t}") for t in range(c)), F.lit(0.0))
    return j.select("worker_id", "task_id", F.col("label").cast("int").alias("label"),
                    prob.alias("prob"))
