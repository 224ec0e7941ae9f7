"""Quality rules with risk-controlled thresholds [native].

Base rules reject very short and very repetitive texts.  Four further rules
compare a ratio with a cutoff that is chosen per stratum (language) on labelled
rows: a cutoff is certified when an exact binomial bound says that it falsely
rejects at most a given share (risk) of the good documents.  Equal texts are one
trial.  Cutoffs of one rule and stratum are tested in a fixed order, laxest first,
until one fails (no correction is needed inside such a chain); the chains share
the error level ``delta`` by Bonferroni: half of it goes to the strata, half to a
pooled chain.  Strata with too few good texts to certify anything share that one,
and a chain takes the least of ``risks`` that its number of trials can certify.
Both choices look at numbers of trials only, never at outcomes.  The grids are
fixed in advance, so every labelled row is a holdout.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdlens.functions.special import lgamma
from crowdlens.llm.common import hot_join, let, table
from crowdlens.session import cut

WINDOW = 8  # fixed value: words of a repeated window
MIN_WORDS, MAX_REPEAT_PCT = 20, 30  # fixed values of the base rules
LANGUAGES = ("en", "fr", "de", "es")  # strata; any other language is one more
RISKS, DELTA = (0.005, 0.01, 0.02), 0.05
POOLED = "(pooled)"  # the chain of strata with few trials
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
# rule -> cutoffs, strictest first: reject when the value exceeds the cutoff
GRIDS = {
    "symbols_pct": (1, 2, 3, 5, 8, 12, 18, 25, 35, 50),  # symbols per 100 word characters
    "dup_lines_pct": (5, 10, 15, 20, 30, 40, 50, 60, 75, 90),  # repeated lines per 100 lines
    "repeat_words_pct": (2, 4, 6, 8, 10, 14, 18, 22, 26, 29),  # words in repeated windows per 100
    "chars_per_word": (7, 8, 9, 10, 12, 14, 16, 20, 30, 40),
}


def repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur at least twice in ``words``."""
    def covered(hashes):  # positions sorted by window; equal neighbours repeat
        keyed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return let(F.array_sort(keyed), lambda s: let(
            F.array_sort(F.transform(F.filter(s, lambda x, j: (
                (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])).eqNullSafe(True)),
                lambda x: x["i"])),
            lambda p: F.aggregate(
                p, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
                lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(
                    F.lit(WINDOW), x - a["last"])).alias("n")))["n"]))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)),
                         lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    some = let(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(F.size(words) > WINDOW, some).otherwise(F.lit(0)).cast("long")


def features(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and the measures of every text; null text has no words.
    All rows stay, repeated ones too."""
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda chars: F.length("_t") - F.length(F.translate("_t", chars, ""))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = df.select(*keep, t.alias("_t")).select(
        *keep, "_t", lines.alias("_lines"),
        F.regexp_extract_all("_t", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("_w"))
    return rows.select(
        *keep, F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        count("#*$%&|<>").cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_w")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def exceeds(rule: str, cutoff: Column | int) -> Column:
    """Integer comparison of a rule's ratio with a cutoff."""
    over, of = {"symbols_pct": (100 * F.col("n_symbols"), "word_chars"),
                "dup_lines_pct": (100 * F.col("n_dup_lines"), "n_lines"),
                "repeat_words_pct": (100 * F.col("n_repeat_words"), "n_words"),
                "chars_per_word": (F.col("word_chars"), "n_words")}[rule]
    return over > F.lit(cutoff) * F.col(of) if isinstance(cutoff, int) else over > cutoff * F.col(of)


def binomial_cdf(k: Column, n: Column, p: Column | float) -> Column:
    """P(Binomial(n, p) <= k) for k < n p, else 1 (only small values matter).

    The largest term by log-gamma, the others from it by their ratios; terms
    beyond 50 standard deviations below k are under 1e-100 of the sum.
    """
    kd, nd, p = k.cast("double"), n.cast("double"), F.lit(p) if isinstance(p, float) else p
    top = F.exp(lgamma(nd + 1) - lgamma(kd + 1) - lgamma(nd - kd + 1)
                + kd * F.log(p) + (nd - kd) * F.log(1 - p))
    steps = F.least(k, (50 * F.sqrt(nd * p * (1 - p)) + 50).cast("long"))
    walked = F.aggregate(
        F.sequence(F.lit(1).cast("long"), steps),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, j: let(a["term"] * (kd - j + 1) / (nd - kd + j) * ((1 - p) / p),
                         lambda t: F.struct(t.alias("term"), (a["sum"] + t).alias("sum"))))["sum"]
    return F.when(kd >= nd * p, F.lit(1.0)).otherwise(top * F.when(steps >= 1, walked).otherwise(F.lit(1.0)))


def needed(risk: float, level: float) -> int:
    """Trials without a false rejection that certify ``risk`` at ``level``."""
    return math.ceil(math.log(level) / math.log(1 - risk) - 1e-9)


def stratum(lang: str, languages=LANGUAGES) -> Column:
    return F.when(F.col(lang).isin(*languages), F.col(lang)).otherwise(F.lit("other"))


def levels(languages, delta: float, grids: dict) -> tuple[float, float]:
    """Error level of a chain of its own and of a pooled one."""
    return delta / 2 / ((len(languages) + 1) * len(grids)), delta / 2 / len(grids)


def thresholds(good: DataFrame, languages=LANGUAGES, risks: tuple[float, ...] = RISKS,
               delta: float = DELTA, grids: dict = GRIDS) -> DataFrame:
    """(stratum, rule, chain, risk, cutoff, n, k): the strictest certified cutoff
    of every rule and stratum, from ``n`` good texts of its chain of which it
    rejects ``k``.  ``good``: ``_stratum``, ``_digest`` (of the text) and the
    measures of good rows.  A chain in which no cutoff passes gives no row: that
    rule rejects nothing."""
    tests = [(r, c) for r, grid in grids.items() for c in grid]
    own, pooled = levels(languages, delta, grids)
    once = [F.first(m).alias(m) for m in MEASURES]
    trials = cut(good.where(~base_failed()).groupBy("_stratum", "_digest").agg(*once), "trials")
    # a row for each stratum, at most len(languages) + 1
    chains = trials.groupBy("_stratum").agg(F.count("*").alias("_n")).select("_stratum", F.when(
        F.col("_n") >= needed(max(risks), own), F.col("_stratum")).otherwise(F.lit(POOLED)).alias("chain"))
    # one row per chain: a sum for each test, combined on the map side
    sums = (trials.join(F.broadcast(chains), "_stratum").groupBy("chain", "_digest").agg(*once)
            .groupBy("chain").agg(F.count("*").alias("n"), *[
                F.sum(exceeds(r, c).cast("long")).alias(f"k_{r}_{c}") for r, c in tests]))
    risk = F.lit(None).cast("double")
    for r in sorted(risks, reverse=True):
        enough = F.when(F.col("chain") == POOLED, needed(r, pooled)).otherwise(needed(r, own))
        risk = F.when(F.col("n") >= enough, F.lit(r)).otherwise(risk)
    rows = sums.withColumn("risk", risk).where("risk is not null").select(
        "chain", "n", "risk", F.explode(F.array(*[
            F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"k_{r}_{c}").alias("k"))
            for r, c in tests])).alias("t")).select("chain", "n", "risk", "t.*")
    level = F.when(F.col("chain") == POOLED, pooled).otherwise(own)
    rows = rows.withColumn("passed", binomial_cdf(F.col("k"), F.col("n"), F.col("risk")) <= level)
    walked = rows.groupBy("chain", "rule", "risk").agg(
        F.max(F.when(~F.col("passed"), F.col("cutoff"))).alias("failed"),
        F.array_sort(F.collect_list(F.struct("cutoff", "n", "k"))).alias("all"))  # a grid's length
    best = F.get(F.filter("all", lambda x: F.col("failed").isNull() | (x["cutoff"] > F.col("failed"))), F.lit(0))
    found = walked.select("chain", "rule", "risk", best.alias("b")).where("b is not null")
    return chains.withColumnRenamed("_stratum", "stratum").join(found, "chain").select(
        "stratum", "rule", "chain", "risk", "b.*")


def judge(df: DataFrame, labels: DataFrame, id_col: str, text: str, lang: str, quality: str = "quality",
          languages=LANGUAGES, risks: tuple[float, ...] = RISKS, delta: float = DELTA) -> DataFrame:
    """``id_col``, the measures, ``base_failed``, ``kept``, ``n_certified`` and
    ``risk`` for every row: how many rules have a certified cutoff in the row's
    stratum, and the risk it is certified for (null without any).

    Labels may repeat an id: a document is good when one of its labels says so.
    Labels of null ids or ids that are not in ``df`` count for nothing, an id that
    many rows share is no hot join key.  Where nothing is certified only the base
    rules reject.
    """
    rows = cut(features(df.select(F.col(id_col).alias("_id"), stratum(lang, languages).alias("_stratum"),
                                  F.xxhash64(text).alias("_digest"), F.col(text).alias("_text")),
                        "_text", ["_id", "_stratum", "_digest"]), "measures")
    good = labels.groupBy(F.col(id_col).alias("_id")).agg((F.max(quality) == 1).alias("good")).where("good")
    counts = cut(rows.groupBy("_id").agg(F.count("*").alias("_n")).join(good.select("_id"), "_id"), "good")
    found = thresholds(hot_join(rows, counts, "_id", "_n"), languages, risks, delta)
    # one row per stratum, at most len(languages) + 1: a fixed bound
    wide = cut(found.groupBy(F.col("stratum").alias("_stratum"), "risk").pivot("rule", list(GRIDS)).agg(
        F.first("cutoff")), "cutoffs")
    rejected = F.lit(False)
    certified = F.lit(0).cast("long")
    for rule in GRIDS:
        rejected = rejected | F.coalesce(exceeds(rule, F.col(rule)), F.lit(False))
        certified = certified + F.col(rule).isNotNull().cast("long")
    return (rows.join(F.broadcast(wide), "_stratum", "left")
            .select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    "n_repeat_words", base_failed().alias("base_failed"),
                    (~base_failed() & ~rejected).alias("kept"), certified.alias("n_certified"), "risk"))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract rows for ``documents``, thresholds from ``labels``."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "text", "lang")
