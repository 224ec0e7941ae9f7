"""Secret scan with corpus-wide ownership frequency [native].

Every text is scanned once for candidate credentials.  A candidate's hash is
counted over distinct repositories and distinct owners: a value that many
owners carry is a copied example, one that stays with few owners looks live.
The base patterns are reported whatever the verdict; the frequency decides
which *generic* tokens (mixed case with digits, no fixed prefix) are added, and
which spans ``redact`` replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdlens.llm.common import hot_join, let
from crowdlens.session import cut

# The base patterns; (kind, pattern, value group, least length).
# A run of 16 or more is the same as the greedy run filtered by length.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("generic", r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
)
BASE = 3  # the first kinds are the base; the rest is added by the method
SPAN = "array<struct<start:int,ord:int,end:int,kind:string,key:string,live:boolean>>"


def _key(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 32)


def _running(values: Column) -> Column:
    """Running sums of an array: each pass adds what lies a power of two before, so
    n values take n log n steps (a fold that appends would copy the array n times)."""
    def added(far: int):
        return lambda v: F.when(F.size(v) > far, F.transform(
            v, lambda x, i: x + F.coalesce(F.get(v, i - far), F.lit(0)))).otherwise(v)

    for k in range(27):  # 2**27 hits of 16 characters are more than a string holds
        values = let(values, added(1 << k))
    return values


def _spans(text: Column, ordinal: int) -> Column:
    """Spans of one kind: leftmost non-overlapping matches, code points."""
    kind, pattern, group, least = KINDS[ordinal]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"),
                          found.alias("hit"), values.alias("value"))

    def placed(hits: Column) -> Column:
        ends = _running(F.transform(hits, lambda x: F.length(x["gap"]) + F.length(x["hit"])))
        return let(ends, lambda end: F.filter(F.transform(hits, lambda x, i: F.when(
            _fits(kind, x["value"], least), F.struct(
                (F.get(end, i) - F.length(x["hit"])).alias("start"), F.lit(ordinal).alias("ord"),
                F.get(end, i).alias("end"), F.lit(kind).alias("kind"), _key(x["value"]).alias("key"),
                F.lit(None).cast("boolean").alias("live")))), lambda s: s.isNotNull()))

    return F.when(text.rlike(pattern), let(zipped, placed).cast(SPAN)).otherwise(F.array().cast(SPAN))


def _fits(kind: str, value: Column, least: int) -> Column:
    long_enough = F.length(value) >= least
    if kind != "generic":
        return long_enough
    return long_enough & value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")


def scan(df: DataFrame, text: str, owner: str, repo: str, keep: list[str],
         min_owners: int = 3) -> DataFrame:
    """One row for each row of ``df``: the ``keep`` columns, ``_uid`` and
    ``_spans``: all base spans with ``live`` set, and the generic spans that are
    owner-specific and touch no base span, ordered by start, then kind.

    ``live`` is false when the value was seen with at least ``min_owners``
    distinct owners *and* as many distinct repositories.  Null text counts as
    empty, a null owner or repository as one nameless one.  Repeated rows are
    scanned each; they add no owner.  ``keep`` names must not start with an
    underscore.
    """
    found = cut(df.select(
        *keep, F.monotonically_increasing_id().alias("_uid"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner"),
        F.coalesce(F.col(repo).cast("string"), F.lit("")).alias("_repo"),
        F.array_sort(F.concat(*[_spans(F.coalesce(F.col(text), F.lit("")), i)
                                for i in range(len(KINDS))])).alias("_spans")), "scanned")
    some = cut(found.where(F.size("_spans") > 0)
               .select("_uid", "_owner", "_repo", F.explode("_spans").alias("s"))
               .select("_uid", "_owner", "_repo", "s", F.col("s.key").alias("_key")), "candidates")
    # by owner (or repository) first, so a hot value is combined on the map side
    def distinct(who, count, *more):
        once = some.groupBy("_key", who).agg(F.count("*").alias("n"))
        return once.groupBy("_key").agg(F.count("*").alias(count), *more)

    verdict = cut(distinct("_owner", "owners", F.sum("n").alias("n")).join(distinct("_repo", "repos"), "_key").select(
        "_key", "n", ((F.col("owners") < min_owners) | (F.col("repos") < min_owners)).alias("live")), "ownership")
    judged = (hot_join(some.select("_uid", "s", "_key"), verdict, "_key", "n")
              .select("_uid", F.col("s").withField("live", F.col("live")).alias("s"))
              .groupBy("_uid").agg(F.array_sort(F.collect_list("s")).alias("all")))
    base = F.filter("all", lambda s: s["ord"] < BASE)
    spans = F.filter("all", lambda s: (s["ord"] < BASE) | (s["live"] & ~F.exists(
        F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))
    judged = judged.withColumn("base", base).select("_uid", spans.alias("_judged"))
    found = found.drop("_owner", "_repo")
    hits = found.where(F.size("_spans") > 0).drop("_spans").join(judged, "_uid").select(
        *keep, "_uid", F.col("_judged").alias("_spans"))
    return hits.unionByName(found.where(F.size("_spans") == 0).select(*keep, "_uid", "_spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "<SECRET>") -> Column:
    """``text`` without its live spans; overlapping spans give one mark."""
    walked = F.aggregate(
        F.filter(spans, lambda s: s["live"]),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(
                acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
            .otherwise(acc["out"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.exists(spans, lambda s: s["live"]), walked).otherwise(text)


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Contract rows for ``documents``; owner = source, repository = doc_id."""
    from crowdlens.llm.common import table

    rows = scan(table(spark, sf_dir, "documents"), "text", "source", "doc_id", ["doc_id"])
    base = F.filter("_spans", lambda s: s["ord"] < BASE)
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"),
        F.size(F.filter("_spans", lambda s: s["live"])).cast("long").alias("n_live"))


ORACLE_OP9 = r"""
WITH pats(kind, ord, pat, grp) AS (VALUES
  ('assign', 0, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2),
  ('access', 1, 'AKIA[A-Z0-9]+', 0), ('hex', 2, '[0-9a-f]+', 0), ('generic', 3, '[A-Za-z0-9+/_=-]{20,}', 0)),
d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS own FROM documents),
m AS (
  SELECT uid, doc_id, own, 'assign' AS kind, 0 AS ord, regexp_extract_all(t, (SELECT pat FROM pats WHERE ord = 0)) AS hits,
         regexp_extract_all(t, (SELECT pat FROM pats WHERE ord = 0), 2) AS vals,
         string_split_regex(t, (SELECT pat FROM pats WHERE ord = 0)) AS gaps FROM d
  UNION ALL SELECT uid, doc_id, own, 'access', 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT uid, doc_id, own, 'hex', 2, regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), string_split_regex(t, '[0-9a-f]+') FROM d
  UNION ALL SELECT uid, doc_id, own, 'generic', 3, regexp_extract_all(t, '[A-Za-z0-9+/_=-]{20,}'), regexp_extract_all(t, '[A-Za-z0-9+/_=-]{20,}'), string_split_regex(t, '[A-Za-z0-9+/_=-]{20,}') FROM d),
x AS (SELECT uid, doc_id, own, kind, ord, unnest(hits) AS hit, unnest(vals) AS val, unnest(gaps[1:len(hits)]) AS gap, unnest(range(len(hits))) AS i FROM m),
p AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY uid, ord ORDER BY i) AS e FROM x),
s AS (SELECT uid, doc_id, own, kind, ord, val, (e - length(hit))::BIGINT AS b, e::BIGINT AS e FROM p
  WHERE (ord = 0 AND length(val) >= 12) OR (ord = 1 AND length(hit) >= 18) OR (ord = 2 AND length(hit) >= 16)
     OR (ord = 3 AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[0-9]'))),
v AS (SELECT val, count(DISTINCT own) < 3 OR count(DISTINCT doc_id) < 3 AS live FROM s GROUP BY val),
j AS (SELECT s.*, v.live FROM s JOIN v USING (val)),
k AS (SELECT * FROM j WHERE ord < 3 OR (live AND NOT EXISTS (
  SELECT 1 FROM j b WHERE b.uid = j.uid AND b.ord < 3 AND b.b < j.e AND j.b < b.e))),
g AS (SELECT uid, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
  coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, ord) FILTER (ord < 3), '') AS base,
  string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, ord) AS spans, count(*) FILTER (live) AS n_live FROM k GROUP BY uid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN g USING (uid)
"""
