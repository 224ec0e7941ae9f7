"""Preference formatting with a shared prompt [native].

A chosen and a rejected conversation that start with the same turns are
rendered as one prompt (their longest common turn prefix) and two completions;
the masks give the character spans of a completion that are trained on
(assistant texts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdlens.llm.common import no_clash, ranked, table
from crowdlens.session import cut

OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """One row for each ``conv_id``: its turns in order, as (role, text).

    Null roles read ``user``, null texts are empty, null turn numbers come
    first; ties and repeated turns keep all rows, ordered by role and text.
    Rows of a null conv_id form one conversation.  ``<|`` inside a text or role is
    written ``< |`` and ``|>`` inside a role ``| >``, so that neither can pose as a
    marker.  A conversation is one row, so its turns must fit into a task.
    """
    role = F.replace(F.replace(F.coalesce("role", F.lit("user")), F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    clean = turns.select("conv_id", F.struct(
        F.col("turn"), role.alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text")).alias("t"))
    return clean.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(
        t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n" + CLOSE))), "")


def _mask(turns: Column, role: str = "assistant") -> Column:
    """``start:end`` spans (code points) of the trained texts, comma-joined."""
    head = lambda t: F.length(t["role"]) + len(OPEN.format(""))
    walked = F.aggregate(
        turns, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, t: F.struct(
            (a["at"] + head(t) + F.length(t["text"]) + len("\n" + CLOSE)).alias("at"),
            F.when(t["role"] == role, F.concat(a["out"], F.array(F.concat_ws(
                ":", a["at"] + head(t), a["at"] + head(t) + F.length(t["text"]))))).otherwise(a["out"]).alias("out")))
    return F.array_join(walked["out"], ",")


def format_preferences(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``n_prefix``, ``prompt``, ``chosen``, ``rejected`` and
    the two masks for rows with array columns ``_chosen`` and ``_rejected``.

    A missing side is an empty conversation; equal conversations give two empty
    completions.  The prefix is compared turn by turn (role and text).  ``keep``
    must not hold the names of the new columns.
    """
    no_clash(keep, "n_prefix prompt chosen rejected chosen_mask rejected_mask _a _b")
    a, b = (F.coalesce(F.col(c), F.array()) for c in ("_chosen", "_rejected"))
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(F.transform(same, lambda s: F.when(s, 0).otherwise(1)), 1)
    rows = pairs.select(*keep, a.alias("_a"), b.alias("_b"),
                        F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int").alias("n_prefix"))
    rest = lambda c: F.slice(c, F.col("n_prefix") + 1, F.greatest(F.size(c) - F.col("n_prefix"), F.lit(0)))
    return rows.select(
        *keep, "n_prefix", _render(F.slice("_a", F.lit(1), F.col("n_prefix"))).alias("prompt"),
        _render(rest("_a")).alias("chosen"), _render(rest("_b")).alias("rejected"),
        _mask(rest("_a")).alias("chosen_mask"), _mask(rest("_b")).alias("rejected_mask"))


def pair_order(convs: DataFrame) -> DataFrame:
    """``conv_id``, ``pair_id`` and ``side`` (0, 1) of rows with unique
    ``conv_id``: neighbours in the order of ``opening`` and conv_id (nulls
    first) are paired inside their opening, and pairs are numbered in that order.
    The last conversation of an opening with an odd number has no partner there:
    its pair_id is null, and it shifts no other pair."""
    odd = (convs.groupBy("opening").agg(F.max("conv_id").alias("odd_id"), F.count(F.lit(1)).alias("n"))
           .where("n % 2 = 1").select("odd_id", F.lit(1).alias("odd")))  # unique ids: no opening is a join key
    flagged = convs.join(odd, convs["conv_id"].eqNullSafe(odd["odd_id"]), "left").select(
        F.coalesce("odd", F.lit(0)).alias("odd"), "opening", "conv_id")
    at = F.floor(F.col("_rank") / 2)
    return ranked(flagged, ["odd", "opening", "conv_id"], {}).select(
        "conv_id", F.when(F.col("odd") == 0, at).alias("pair_id"),
        F.when(F.col("odd") == 0, F.col("_rank") % 2).otherwise(0).alias("side"))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """Formatted pairs of a table of conversation turns, paired by their opening
    turn (``pair_order``); the first of a pair is the chosen one.  A conversation
    without a partner is a row with ``paired`` false: it is its own completion, and
    its pair_id and rejected columns are null."""
    convs = conversations(turns)
    first = F.get("turns", F.lit(0))
    convs = cut(convs.withColumn("opening", F.md5(F.concat_ws("\n", first["role"], first["text"]))), "convs")
    order = pair_order(convs.select("conv_id", "opening"))
    placed = convs.join(order, convs["conv_id"].eqNullSafe(order["conv_id"])).select(
        order["conv_id"], "pair_id", "side", "turns")
    side = lambda s, c: F.first(F.when(F.col("side") == s, F.col(c)), ignorenulls=True)
    pairs = placed.where("pair_id is not null").groupBy("pair_id").agg(  # two rows a group
        side(0, "conv_id").alias("chosen_id"), side(1, "conv_id").alias("rejected_id"),
        side(0, "turns").alias("_chosen"), side(1, "turns").alias("_rejected"), F.lit(True).alias("paired"))
    alone = placed.where("pair_id is null").select(
        "pair_id", F.col("conv_id").alias("chosen_id"), F.lit(None).cast("long").alias("rejected_id"),
        F.col("turns").alias("_chosen"), F.lit(None).cast(placed.schema["turns"].dataType).alias("_rejected"),
        F.lit(False).alias("paired"))
    rows = format_preferences(pairs.unionByName(alone), ["pair_id", "paired", "chosen_id", "rejected_id"])
    return rows.withColumns({c: F.when(F.col("paired"), F.col(c)) for c in ("rejected", "rejected_mask")})


def op3_preference_format(spark, sf_dir: str) -> DataFrame:
    """All ``conversations`` as preference pairs: the pairs of an opening are linear
    in its conversations, and each conversation is in one row."""
    return preference_pairs(table(spark, sf_dir, "conversations"))


ORACLE_OP3 = r"""
WITH t AS (SELECT conv_id, turn, replace(replace(coalesce(role, 'user'), '<|', '< |'), '|>', '| >') AS role,
    replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM t),
c AS (SELECT conv_id, md5(max(role || chr(10) || text) FILTER (i = 0)) AS opening FROM n GROUP BY conv_id),
o AS (SELECT conv_id, opening, row_number() OVER (PARTITION BY opening ORDER BY conv_id NULLS FIRST) - 1 AS r,
    count(*) OVER (PARTITION BY opening) AS size FROM c),
w AS (SELECT conv_id, opening, r, NOT (r = size - 1 AND size % 2 = 1) AS paired FROM o),
u AS (SELECT opening, r // 2 AS h, row_number() OVER (ORDER BY opening, r // 2) - 1 AS pair_id
  FROM w WHERE paired AND r % 2 = 0),
q AS (SELECT w.conv_id, w.paired, w.r % 2 AS side, u.pair_id,
    coalesce(u.pair_id::VARCHAR, 'alone ' || coalesce(w.conv_id::VARCHAR, 'null')) AS g
  FROM w LEFT JOIN u ON w.paired AND u.opening = w.opening AND u.h = w.r // 2),
p AS (SELECT q.pair_id, q.paired, q.g, CASE WHEN q.paired THEN q.side ELSE 0 END AS side, n.*
  FROM n JOIN q ON n.conv_id IS NOT DISTINCT FROM q.conv_id),
f AS (SELECT coalesce(a.g, b.g) AS g, coalesce(a.i, b.i) AS i,
       coalesce(a.role = b.role AND a.text = b.text, false) AS same
  FROM (SELECT * FROM p WHERE side = 0) a FULL JOIN (SELECT * FROM p WHERE side = 1) b ON a.g = b.g AND a.i = b.i),
l AS (SELECT g, coalesce(min(i) FILTER (NOT same), count(*))::INTEGER AS n_prefix FROM f GROUP BY g),
x AS (SELECT p.*, l.n_prefix, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS piece FROM p JOIN l USING (g)),
y AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY g, side, i >= n_prefix ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM x)
SELECT max(pair_id)::BIGINT AS pair_id, bool_and(paired) AS paired,
  max(conv_id) FILTER (side = 0) AS chosen_id, max(conv_id) FILTER (side = 1) AS rejected_id, max(n_prefix) AS n_prefix,
  coalesce(string_agg(piece, '' ORDER BY i) FILTER (side = 0 AND i < n_prefix), '') AS prompt,
  coalesce(string_agg(piece, '' ORDER BY i) FILTER (side = 0 AND i >= n_prefix), '') AS chosen,
  CASE WHEN bool_and(paired) THEN coalesce(string_agg(piece, '' ORDER BY i) FILTER (side = 1 AND i >= n_prefix), '') END AS rejected,
  coalesce(string_agg((off + length(role) + 5) || ':' || (off + length(role) + 5 + length(text)), ',' ORDER BY i) FILTER (side = 0 AND i >= n_prefix AND role = 'assistant'), '') AS chosen_mask,
  CASE WHEN bool_and(paired) THEN coalesce(string_agg((off + length(role) + 5) || ':' || (off + length(role) + 5 + length(text)), ',' ORDER BY i) FILTER (side = 1 AND i >= n_prefix AND role = 'assistant'), '') END AS rejected_mask
FROM y GROUP BY g
"""
