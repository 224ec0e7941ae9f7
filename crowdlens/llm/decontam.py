"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton of the normalised test items is built once per block of items
and sent to the tasks; training words are streamed through it, tracking the
longest match that ends at each word.  A match of WINDOW words (or a whole item
that is shorter) marks its words as hit.  Spark splits the items into words, makes
equal items one class and deals the classes to blocks by prefix sums of their
sizes.  There is one pass over the documents for each block, and a task and the
driver hold one block at a time, so what is broadcast never grows with the
benchmark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlens.llm.common import aliased, arrow_fields, byte_slices, hot_join, no_clash, ranked, restored, table
from crowdlens.llm.words import joined_bytes, mix, split_words, BASE
from crowdlens.session import cut, scratch_path

WINDOW = 10  # words of a window
BLOCK_BYTES = 1 << 20  # item text per automaton (some 130 MB in a Python worker)
CLASS_IDS = 10_000  # ids of equal items in one row; more are several classes
MAX_COVERAGE = 0.8  # a document with a larger hit share is dropped by ``clean``


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, with item sets.

    ``windows[s]``: items that contain the WINDOW words which end in state s (set
    where the state holds strings of that length); ``whole[s]``: short items,
    as (length, item), that are a suffix of every match ending in s.
    """

    def __init__(self, items: list[tuple[int, list[int]]], window: int = WINDOW):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.windows: dict[int, set] = {}
        ends: dict[int, list] = {}
        for name, words in items:
            state = length = 0
            for i, w in enumerate(words):
                state, length = self.step(state, length, w)
                if length >= window and i + 1 >= window:
                    self.windows.setdefault(self.ancestor(state, window), set()).add(name)
            if 0 < len(words) < window:
                ends.setdefault(self.ancestor(state, len(words)), []).append((len(words), name))
        self.whole: dict[int, list] = {}
        if ends:
            for s in sorted(range(1, len(self.len)), key=self.len.__getitem__):
                found = self.whole.get(self.link[s], []) + ends.get(s, [])
                if found:
                    self.whole[s] = found

    def _new(self, length: int, nexts: dict[int, int], link: int) -> int:
        self.next.append(nexts)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """The state for w after p when q also holds longer strings."""
        if self.len[q] == self.len[p] + 1:
            return q
        clone = self._new(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, self.next[last][w], w)
        cur = self._new(self.len[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        self.link[cur] = 0 if p < 0 else self._split(p, self.next[p][w], w)
        return cur

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """The longest suffix of (match + w) that is in an item."""
        nexts, link = self.next, self.link
        while state and w not in nexts[state]:
            state = link[state]
            length = self.len[state]
        to = nexts[state].get(w)
        return (0, 0) if to is None else (to, length + 1)

    def ancestor(self, state: int, length: int) -> int:
        """The state that holds the suffix of this length."""
        while self.len[self.link[state]] >= length:
            state = self.link[state]
        return state


def item_classes(items: DataFrame, id_col: str, text: str) -> DataFrame:
    """``words`` (hashes), ``names`` (ids as text) and ``size`` (bytes) of the
    distinct word lists of the items that have a word, as a written table; its
    ``observed["bytes"]`` is their total.  Null ids are not listed."""

    def run(batches):
        for batch in byte_slices(batches, "_text"):
            words = split_words(*joined_bytes(batch.column("_text")))
            lists = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_name"), pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in lists],
                                                 pa.binary()),
                 pa.array([x.view(np.int64) for x in lists], pa.list_(pa.int64()))], ["_name", "_key", "words"])

    base = items.select(F.col(id_col).cast("string").alias("_name"), F.col(text).alias("_text"))
    rows = cut(base.mapInArrow(run, "_name string, _key binary, words array<long>").where(F.size("words") > 0), "items")
    counts = cut(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")), "item-counts")
    part = F.pmod(F.xxhash64("_name"), F.ceil(F.col("_n") / CLASS_IDS))
    ids = hot_join(rows.select("_key", "_name"), counts, "_key", "_n").groupBy("_key", part.alias("_part")).agg(
        F.collect_set("_name").alias("names"))  # about CLASS_IDS at most
    words = rows.groupBy("_key").agg(F.first("words").alias("words"))
    size = 8 * F.size("words") + F.aggregate("names", F.lit(0), lambda a, x: a + F.octet_length(x))
    return cut(ids.join(words, "_key").withColumn("size", size.cast("long")), "item-classes",
               {"bytes": F.sum("size")})


def _block(rows: DataFrame) -> list[tuple[list[str], list[int]]]:
    """(names, word hashes) of the classes of one block."""
    return [(r.names, np.array(r.words, dtype=np.int64).view(np.uint64).tolist())
            for r in rows.select("names", "words").collect()]


def _pairs(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * BASE + h[1:])


class Matcher:
    """Hits of one block of item classes, known by their place, in batches of texts."""

    def __init__(self, items: list, window: int):
        self.window = window
        self.automaton = SuffixAutomaton([(i, words) for i, (_, words) in enumerate(items)], window)
        self.least = min([window, *(len(w) for _, w in items)])
        self.words = np.unique(np.array([w for _, ws in items for w in ws], dtype=np.uint64))
        self.pairs = np.unique(np.concatenate(
            [_pairs(np.array(ws, dtype=np.uint64)) for _, ws in items] or [np.zeros(0, np.uint64)]))

    def stretches(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
        """Maximal word ranges that could hold a hit: every word, and every pair
        of neighbours, is in an item.  Whatever lies outside cannot match."""
        known = np.isin(h, self.words)
        chain = np.zeros(len(h) + 1, dtype=bool)  # chain[i]: word i goes on from word i - 1
        if len(h) > 1 and len(self.pairs):
            both = np.flatnonzero(known[:-1] & known[1:]) + 1
            chain[both] = np.isin(_pairs(h)[both - 1], self.pairs)
        chain[first] = False
        begin = np.flatnonzero(known & ~chain[:-1])
        stop = np.flatnonzero(known & ~chain[1:]) + 1
        long = stop - begin >= self.least
        return zip(begin[long].tolist(), stop[long].tolist())

    def hits(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict[int, set]]:
        """A mark for each hit word, and the items found, by text."""
        marks = np.zeros(len(h) + 1, dtype=np.int32)
        found: dict[int, set] = {}
        a, w = self.automaton, self.window
        for begin, stop in self.stretches(h, first):
            state = length = 0
            for i, word in enumerate(h[begin:stop].tolist(), begin):
                state, length = a.step(state, length, word)
                names, reach = [], 0
                if length >= w:
                    reach = w
                    names += a.windows.get(a.ancestor(state, w), ())
                for n, name in a.whole.get(state, ()):
                    if n <= length:
                        names.append(name)
                        reach = max(reach, n)
                if reach:
                    marks[i + 1 - reach] += 1
                    marks[i + 1] -= 1
                    found.setdefault(int(np.searchsorted(first, i, "right")) - 1, set()).update(names)
        return np.cumsum(marks[:-1]) > 0, found


def spans_of(df: DataFrame, items: DataFrame, text: str, keep: list[str], item_id: str = "item_id",
             item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns, ``n_words``, ``n_hit``, ``items`` (sorted ids as text)
    and ``spans`` (array of hit word runs: [start, end) in UTF-8 bytes, words).

    Null text has no words; items without a word match nothing; an item with a
    null id marks words but is not listed; equal items are all listed, an id
    that repeats is listed once.  With no items nothing is hit.  ``keep`` must not
    hold the names of the new columns, ``_text`` or ``_uid``.
    """
    no_clash(keep, "n_words n_hit items spans _text _uid _all")
    classes = item_classes(items, item_id, item_text)
    total = classes.observed["bytes"] or 0
    base = df.select(*keep, F.col(text).alias("_text"))
    if total <= block_bytes:  # the usual case: one block, one pass, no join
        return _match(base, keep, _block(classes), window)
    block = F.floor(F.col("_before_size") / block_bytes).cast("int").alias("block")  # by its first byte
    blocks = cut(ranked(classes.select("_key", "_part", "names", "words", "size"), ["_key", "_part"],
                        {"size": F.col("size")}).select("names", "words", block), "blocks")
    base = cut(base.withColumn("_uid", F.monotonically_increasing_id()), "docs")
    folder = scratch_path(base.sparkSession, "hits")  # the passes leave their hits in one table
    for i in range(-(-total // block_bytes)):
        if held := _block(blocks.where(F.col("block") == i)):
            cut(_match(base.select("_uid", "_text"), ["_uid"], held, window, only_hits=True)
                .select("_uid", "items", "spans"), "hits", path=f"{folder}/block={i}")
    merged = base.sparkSession.read.parquet(folder).groupBy("_uid").agg(  # one row for each block at most
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("_all"))
    rows = base.join(merged, "_uid", "left").drop("_uid")
    return _merge(rows, keep)


OUT = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())])
COLUMNS = ("n_words long, n_hit long, items array<string>, "
           "spans array<struct<start:long,end:long,words:long>>")


def _match(base: DataFrame, keep: list[str], block: list, window: int, only_hits: bool = False) -> DataFrame:
    shared = base.sparkSession.sparkContext.broadcast(block)  # at most block_bytes and one class

    def run(batches):
        matcher = Matcher(shared.value, window)
        for batch in byte_slices(batches, "_text"):
            data, offsets = joined_bytes(batch.column("_text"))
            words = split_words(data, offsets)
            hit, found = matcher.hits(words.hash, words.first)
            sums = np.concatenate(([0], np.cumsum(hit)))
            spans: list = [[] for _ in range(batch.num_rows)]
            for d in found:
                lo, hi = words.first[d], words.first[d + 1]
                edge = np.diff(np.concatenate(([0], hit[lo:hi].astype(np.int8), [0])))
                begin, stop = np.flatnonzero(edge == 1) + lo, np.flatnonzero(edge == -1) + lo - 1
                spans[d] = [{"start": s, "end": e, "words": n} for s, e, n in zip(
                    (words.start[begin] - offsets[d]).tolist(), (words.end[stop] - offsets[d]).tolist(),
                    (stop - begin + 1).tolist())]
            out = pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in keep],
                pa.array(np.diff(words.first), pa.int64()),
                pa.array(sums[words.first[1:]] - sums[words.first[:-1]], pa.int64()),
                pa.array([sorted({x for k in found.get(d, ()) for x in shared.value[k][0]})
                          for d in range(batch.num_rows)], pa.list_(pa.string())),
                pa.array(spans, pa.list_(OUT)),
            ], [*keep, "n_words", "n_hit", "items", "spans"])
            yield out.filter(pa.array(np.isin(np.arange(batch.num_rows), list(found)))) if only_hits else out

    return base.mapInArrow(run, arrow_fields(base, keep) + COLUMNS)


def _merge(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Unites the overlapping spans of several blocks and counts their words."""

    def run(batches):
        for batch in byte_slices(batches, "_text"):
            data, offsets = joined_bytes(batch.column("_text"))
            words = split_words(data, offsets)
            spans, hits = [], []
            for d, found in enumerate(batch.column("_all").to_pylist()):
                own: list = []
                starts = words.start[words.first[d]:words.first[d + 1]] - offsets[d]
                ends = words.end[words.first[d]:words.first[d + 1]] - offsets[d]
                mark = np.zeros(len(starts) + 1, dtype=np.int32)
                for s in found or []:
                    mark[np.searchsorted(starts, s["start"])] += 1
                    mark[np.searchsorted(ends, s["end"]) + 1] -= 1
                hit = np.cumsum(mark[:-1]) > 0
                edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
                for b, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1):
                    own.append({"start": int(starts[b]), "end": int(ends[e]), "words": int(e - b + 1)})
                spans.append(own)
                hits.append(int(hit.sum()))
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in keep], pa.array(np.diff(words.first), pa.int64()),
                pa.array(hits, pa.int64()),
                pa.array([x or [] for x in batch.column("items").to_pylist()], pa.list_(pa.string())),
                pa.array(spans, pa.list_(OUT))], [*keep, "n_words", "n_hit", "items", "spans"])

    return rows.mapInArrow(run, arrow_fields(rows, keep) + COLUMNS)


def clean(df: DataFrame, items: DataFrame, text: str = "text", max_coverage: float = MAX_COVERAGE,
          window: int = WINDOW, item_id: str = "item_id", item_text: str = "text",
          min_words: int | None = None) -> DataFrame:
    """``df`` with the hit spans cut out of ``text`` that have at least ``min_words``
    words (a window by default: a phrase that is a whole short item stays where it
    is part of other prose); a document of which more than ``max_coverage`` of the
    words are hit is dropped.  All columns pass through; texts without a span to
    cut are unchanged (null stays null)."""
    inner, keep = aliased(df)
    body = keep[df.columns.index(text)]
    rows = spans_of(inner, items, body, keep, item_id, item_text, window)
    rows = rows.where(F.col("n_hit") <= max_coverage * F.col("n_words")).withColumn(
        "spans", F.filter("spans", lambda s: s["words"] >= (window if min_words is None else min_words)))
    raw = F.encode(body, "utf-8")
    walked = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out")),
        lambda a, s: F.struct(s["end"].alias("pos"), F.concat(
            a["out"], F.decode(F.substring(raw, (a["pos"] + 1).cast("int"), (s["start"] - a["pos"]).cast("int")),
                               "utf-8")).alias("out")),
        lambda a: F.concat(a["out"], F.decode(F.substring(raw, (a["pos"] + 1).cast("int"), F.length(raw)), "utf-8")))
    cleaned = F.when(F.size("spans") > 0, walked).otherwise(F.col(body))
    return restored(rows.withColumn(body, cleaned), df.columns)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contract rows for ``documents`` against ``benchmark``."""
    rows = spans_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "text", ["doc_id"])
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, unnest([array_to_string(w[i:i + least(10, len(w)) - 1], ' ') FOR i IN range(1, greatest(len(w) - 10, 0) + 2)]) AS g FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT uid, k, unnest(range(1, len(w) - k + 2)) AS i, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS g FROM d, ks WHERE len(w) >= k),
m AS (SELECT dw.uid, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
h AS (SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT uid, unnest(range(i, i + k)) AS p FROM m) GROUP BY uid),
s AS (SELECT uid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT uid, item_id::VARCHAR AS x FROM m WHERE item_id IS NOT NULL) GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (uid) LEFT JOIN s USING (uid)
"""
