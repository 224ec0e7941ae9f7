"""Filter interaction audit on failing-id relations.

Every filter gets a stored table of the ids that fail it.  The documents that
fail anything are split by those tables, one after the other, each time into the
rows found (left-semi) and not found (left-anti).  The pieces that result are
disjoint, and every prefix of every filter order is a union of them: survivors
are the pieces outside all tables of the prefix, removals the survivors inside
the next table, redundancies its ids outside the survivors.  So 2 joins a filter
serve all orders, only ids (no texts) move, and a row moves at most once for
each filter.  Label losses come from the label ids joined the same way.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdlens.llm.common import hot_join, table
from crowdlens.session import cut, release

MAX_FILTERS = 6  # orders grow with the factorial, pieces with the power of two
BLANKS = " \t\n\x0b\x0c\r"


def repeats(rows: DataFrame) -> DataFrame:
    """``_uid`` of the ``rows`` (_uid, _id, _digest) whose digest also occurs with a
    smaller ``_id``.  Null ids are neither smaller nor larger than others."""
    groups = (rows.groupBy("_digest").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most"),
                                          F.count(F.lit(1)).alias("_n")).where("_least < _most"))
    return hot_join(rows, groups, "_digest", "_n").where("_id > _least").select("_uid")


def split_by(ids: DataFrame, failing: list[DataFrame]) -> DataFrame:
    """``ids`` with ``_mask``: bit i is set for the rows found in ``failing[i]``.

    Each step writes both parts of every piece as one table, so a lost executor
    repeats one step and the plan stays two joins deep.  ``_uid`` is unique:
    no join key is hot.
    """
    pieces = cut(ids.withColumn("_mask", F.lit(0)), "pieces")
    for bit, found in enumerate(failing):
        inside = pieces.join(found, "_uid", "left_semi").withColumn("_mask", F.col("_mask") + F.lit(1 << bit))
        step = cut(inside.unionByName(pieces.join(found, "_uid", "left_anti")), "pieces")
        release(pieces)
        pieces = step
    return pieces


def with_labels(ids: DataFrame, labels: DataFrame, id_col: str, marks: dict[str, Column]) -> DataFrame:
    """``ids`` with one boolean for each of ``marks``: some label row of the same
    id fulfils it.  Labels may repeat ids; null ids match nothing.  An id that
    many rows share is no hot join key (``hot_join``)."""
    wanted = labels.groupBy(F.col(id_col).alias("_id")).agg(
        *[F.coalesce(F.max(mark), F.lit(False)).alias(name) for name, mark in marks.items()])
    some = wanted.where(" or ".join(f"`{m}`" for m in marks))
    counts = ids.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).join(some, "_id")
    found = hot_join(ids.select("_uid", "_id"), cut(counts, "labelled"), "_id", "_n").select("_uid", *marks)
    return ids.join(found, "_uid", "left").withColumns({m: F.coalesce(m, F.lit(False)) for m in marks})


def audit(docs: DataFrame, filters: dict[str, Column], labels: DataFrame, id_col: str, text: str, part: str,
          duplicate: str | None = None) -> DataFrame:
    """One row for each value of ``part``, order of ``filters`` and step.

    ``filters`` maps one-letter names to failure conditions over the columns
    ``_id``, ``_part`` and ``_text``; ``duplicate`` names one more filter that
    fails texts which also occur with a smaller id.  Null texts and parts are
    empty strings, a condition that is null does not fail, repeated rows count
    each, tables without rows give no rows, other columns of ``docs`` are not
    looked at.  ``labels`` has ``id_col``, ``quality`` and ``toxic``.
    """
    names = [*filters, *([duplicate] if duplicate else [])]
    if len(names) > MAX_FILTERS or any(len(n) != 1 for n in names) or len(set(names)) < len(names):
        raise ValueError(f"at most {MAX_FILTERS} filters with distinct one-letter names")
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("_part"),
                       F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = cut(base.select(
        F.monotonically_increasing_id().alias("_uid"), "_id", "_part",
        *([F.unhex(F.sha2("_text", 256)).alias("_digest")] if duplicate else []),
        *[F.coalesce(c, F.lit(False)).alias(f"_fails_{n}") for n, c in filters.items()]), "measured")
    failing = [cut(rows.where(f"_fails_{n}").select("_uid"), f"failing-{n}") for n in filters]
    if duplicate:
        failing.append(cut(repeats(rows.select("_uid", "_id", "_digest")), f"failing-{duplicate}"))

    anywhere = failing[0]
    for found in failing[1:]:
        anywhere = anywhere.unionByName(found)
    ids = cut(rows.select("_uid", "_id", "_part").join(anywhere, "_uid", "left_semi"), "failing-any")
    marks = {"_good": F.col("quality") == 1, "_toxic": F.col("toxic") == 1}
    pieces = split_by(with_labels(ids, labels, id_col, marks).drop("_id"), failing)

    # at most 2**filters rows a part from here on
    sums = pieces.groupBy("_part", "_mask").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_good").alias("good"), F.count_if("_toxic").alias("toxic"))
    by_part = sums.groupBy("_part").agg(F.collect_list(F.struct("_mask", "n", "good", "toxic")).alias("_pieces"))
    totals = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_all"))
    held = F.coalesce("_pieces", F.array().cast("array<struct<_mask:int,n:bigint,good:bigint,toxic:bigint>>"))
    steps = [F.struct(F.lit("".join(names[i] for i in order)).alias("filter_order"), F.lit(at + 1).alias("step"),
                      F.lit(1 << order[at]).alias("_bit"), F.lit(sum(1 << i for i in order[:at])).alias("_before"))
             for order in permutations(range(len(names))) for at in range(len(names))]
    out = (totals.join(by_part, "_part", "left").select("_part", "_all", held.alias("_pieces"),
                                                       F.explode(F.array(*steps)).alias("_step"))
           .select("_part", "_all", "_pieces", "_step.*"))

    def total(measure, keep) -> Column:
        return F.aggregate(F.filter("_pieces", keep), F.lit(0).cast("long"), lambda a, p: a + measure(p))

    inside = lambda p: p["_mask"].bitwiseAND(F.col("_bit")) != 0
    earlier = lambda p: p["_mask"].bitwiseAND(F.col("_before")) != 0
    removed = lambda p: inside(p) & ~earlier(p)
    orders = factorial(len(names))
    # of all orders, a document's filters each come first among its own equally often
    share = lambda p: (p["n"] * orders / F.bit_count(p["_mask"])).cast("long")
    return out.select(
        F.col("_part").alias("part"), "filter_order", "step",
        (F.col("_all") - total(lambda p: p["n"], lambda p: inside(p) | earlier(p))).alias("kept"),
        total(lambda p: p["n"], removed).alias("removed"),
        total(lambda p: p["n"], lambda p: inside(p) & earlier(p)).alias("redundant"),
        total(lambda p: p["n"], lambda p: p["_mask"] == F.col("_bit")).alias("unique_fails"),
        total(lambda p: p["good"], removed).alias("good_lost"),
        total(lambda p: p["toxic"], removed).alias("toxic_lost"),
        total(share, inside).alias("shapley"))


def word_filters() -> dict[str, Column]:
    """Filters A to D of ``op13_filter_audit`` as failure conditions on ``_text``."""
    text = F.col("_text")
    bare = F.btrim(text, F.lit(BLANKS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": F.size(words) < 50,
            "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
            "C": 100 * upper > 5 * F.length(text),
            "D": text.rlike(r"[#$%&*|]")}


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Contract rows for ``documents`` by source: short, repetitive, upper-case and
    symbol texts, and copies of texts with a smaller doc_id."""
    return audit(table(spark, sf_dir, "documents"), word_filters(), table(spark, sf_dir, "labels"),
                 "doc_id", "text", "source", duplicate="E")


ORACLE_OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS fails FROM d),
x AS (SELECT part, fails, count(*) AS n,
    count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL)) AS good,
    count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)) AS toxic
  FROM m GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, b)),
o AS (SELECT f1.name || f2.name || f3.name || f4.name || f5.name AS filter_order, [f1.b, f2.b, f3.b, f4.b, f5.b] AS bits
  FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.b + f2.b + f3.b + f4.b + f5.b = 31
    AND len(list_distinct([f1.b, f2.b, f3.b, f4.b, f5.b])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM o, generate_series(1, 5) g(step)),
r AS (SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (fails & (before | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (fails & before = 0 AND fails & bit <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails & before <> 0 AND fails & bit <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails & before = 0 AND fails & bit <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (fails & before = 0 AND fails & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM x, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
