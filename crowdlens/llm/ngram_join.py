"""Chosen-path similarity join on the Jaccard similarity of 5-word shingles.

Equal shingle sets are one class from the start (one digest, one group-by).
The class representatives carry MinHash tokens; a run walks a random tree in
which a node picks each token coordinate with probability 1 / (similarity x
tokens) and splits its sets by the value there, so a similar pair is expected
to stay together in one child.  Small buckets are compared by brute force, large
ones are split further, and runs repeat until the target recall.  Buckets that
no split makes small (near copies of one text) are compared in blocks that many
tasks share.  Sketch comparisons only propose: linked sets are gathered by
connected component and every pair in a component is verified on its full sets.

Nothing quadratic is emitted: buckets give a spanning forest, verification gives
link counts and a spanning forest.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlens.llm.common import (
    aliased, byte_slices, components, groups, hot_join, may_match, restored, table)
from crowdlens.llm.words import BASE, U, joined_bytes, mix, shingles, split_words
from crowdlens.session import cut, release, setting

SHINGLE, SIMILARITY = 5, 0.8
TOKENS = 96  # MinHash tokens of a set
RECALL, DEPTH = 0.999, 3  # target for a pair at the threshold, levels of splitting
SMALL = 256  # sets of a bucket that is compared at once
SKETCHES = 512, 8192  # sketches of a block of a bucket that stays large: an eighth of it, between these
BLOCK = 128, 512  # sets of a block of a large component: a sixteenth of it, between these
BLOCK_SHINGLES = 1_000_000  # shingles of a block, at most (unless one set is larger)
SLACK = 4.0  # standard deviations by which a sketch may fall short
EDGE = "a long, b long"
MULTIPLY = mix(np.arange(1, TOKENS + 1, dtype=U) * BASE) | U(1)
# tables of ids are written so small that Spark would take millions of rows through the driver
DEALT = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def runs_for(recall: float, similarity: float, tokens: int, depth: int) -> int:
    """Runs after which a pair at the threshold met in a small bucket with
    probability ``recall``: its survival through one node is s(x) = 1 - (1 -
    similarity p x) ** tokens with p = 1 / (similarity tokens)."""
    x = 1.0
    for _ in range(depth):
        x = 1 - (1 - x / tokens) ** tokens
    return math.ceil(math.log(1 - recall) / math.log(1 - x))


def chosen(run: int, node: np.ndarray, similarity: float) -> np.ndarray:
    """Marks (node, token): which coordinates each node picks in a run.  A root
    that would pick none takes one, so that no run is empty."""
    h = mix(node[:, None] + MULTIPLY[None, :] * U(2 * run + 1))
    picked = h < U(int(2.0**64 / (similarity * TOKENS)))
    none = ~picked.any(axis=1)
    picked[none, np.argmin(h[none], axis=1)] = True
    return picked


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, joined, and n + 1 offsets.  A text
    of fewer than 5 words has one shingle (all its words); one of no words none."""
    words = split_words(data, offsets)
    values, first = shingles(words.hash, words.first, SHINGLE)
    count = np.diff(words.first)
    out, sizes = [], np.zeros(len(count), np.int64)
    for i, n in enumerate(count.tolist()):
        if n >= SHINGLE:
            own = np.unique(values[first[i]:first[i + 1]])
        elif n:
            h = words.hash[words.first[i]:words.first[i + 1]]
            own = np.array([U(n)], dtype=U)
            for x in h:
                own = mix(own * BASE + x)
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, U)), np.concatenate(([0], np.cumsum(sizes)))


def _sketches(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash tokens (rows: non-empty sets, 32 bits each)."""
    out = np.empty((len(first), TOKENS), dtype=np.uint32)
    for t in range(TOKENS):
        h = values * MULTIPLY[t]
        h ^= h >> U(29)
        h *= MULTIPLY[TOKENS - 1 - t]
        out[:, t] = np.minimum.reduceat((h >> U(32)).astype(np.uint32), first)
    return out


def _signed(docs: DataFrame) -> DataFrame:
    """(_id, digest, n, tokens, sketch) of each (_id, _text): the tokens, and the
    last byte of each for comparisons.  Empty sets have a null digest."""

    def run(batches):
        for batch in byte_slices(batches, "_text", 2 << 20):
            values, first = shingle_sets(*joined_bytes(batch.column("_text")))
            size = np.diff(first)
            full = np.flatnonzero(size)
            sketch = _sketches(values, first[full]) if len(full) else np.zeros((0, TOKENS), np.uint32)
            digest: list = [None] * batch.num_rows
            tokens: list = [None] * batch.num_rows
            short: list = [None] * batch.num_rows
            for row, i in enumerate(full.tolist()):
                digest[i] = hashlib.blake2b(values[first[i]:first[i + 1]].tobytes(), digest_size=16).digest()
                tokens[i], short[i] = sketch[row].tobytes(), sketch[row].astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(digest, pa.binary()), pa.array(size, pa.int64()),
                 pa.array(tokens, pa.binary()), pa.array(short, pa.binary())],
                ["_id", "digest", "n", "tokens", "sketch"])

    return docs.mapInArrow(run, "_id long, digest binary, n long, tokens binary, sketch binary")


def _paths(sets: DataFrame, n_runs: int, similarity: float) -> DataFrame:
    """(path, run, id) of the first level for each (id, tokens)."""

    def run(batches):
        picks = [np.flatnonzero(chosen(r, np.zeros(1, U), similarity)[0]) for r in range(n_runs)]
        runs = np.repeat(np.arange(n_runs), [len(p) for p in picks])
        flat = np.concatenate(picks)
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(-1, TOKENS)
            path = mix(tokens[:, flat].astype(U) * BASE + mix((flat * 1000 + runs).astype(U)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(path.ravel().view(np.int64)), pa.array(np.tile(runs, len(tokens)).astype(np.int32)),
                 pa.array(np.repeat(batch.column("id").to_numpy(), len(flat)))], ["path", "run", "id"])

    return sets.select("id", "tokens").mapInArrow(run, "path long, run int, id long")


def _deeper(large: DataFrame, similarity: float) -> DataFrame:
    """Children of (path, run, id, tokens)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(-1, TOKENS)
            path = batch.column("path").to_numpy().view(U)
            runs = batch.column("run").to_numpy()
            marks = np.zeros(tokens.shape, dtype=bool)
            for r in np.unique(runs):
                at = runs == r
                marks[at] = chosen(int(r), path[at], similarity)
            row, token = np.nonzero(marks)
            child = mix(mix(path[row] + token.astype(U) * BASE) + tokens[row, token].astype(U))
            yield pa.RecordBatch.from_arrays(
                [pa.array(child.view(np.int64)), pa.array(runs[row]), batch.column("id").take(pa.array(row))],
                ["path", "run", "id"])

    return large.select("path", "run", "id", "tokens").mapInArrow(run, "path long, run int, id long")


def _forest(n: int, near) -> list[tuple[int, int]]:
    """Edges of a spanning forest over 0..n-1; ``near(i, others)`` marks the
    neighbours of i.  A row is compared only with rows not reached yet, so a
    dense group costs few comparisons."""
    rest, edges = np.arange(n), []
    while len(rest) > 1:
        stack, rest = [int(rest[0])], rest[1:]
        while stack and len(rest):
            i = stack.pop()
            hit = near(i, rest)
            if hit.any():
                new = rest[hit].tolist()
                edges += [(i, j) for j in new]
                stack += new
                rest = rest[~hit]
    return edges


def _bridges(side: np.ndarray, near) -> list[tuple[int, int]]:
    """Edges between the two sides that join what each side's own links (found by
    the group of that side alone, and not given again) leave apart: with those, all
    pairs of the two blocks stay connected, and a dense group gives one edge."""
    label = np.arange(len(side))
    halves = [np.flatnonzero(side == s) for s in np.unique(side)]
    for half in halves:
        for a, b in _forest(len(half), lambda i, others, half=half: near(half[i], half[others])):
            label[half[b]] = label[half[a]]  # a forest gives a parent before its children
    edges = []
    for i in halves[0].tolist() if len(halves) == 2 else ():
        far = halves[1][label[halves[1]] != label[i]]
        for j in far[near(i, far)].tolist() if len(far) else ():
            if label[j] != label[i]:
                edges.append((i, j))
                label[label == label[j]] = label[i]
    return edges


def _blocked(rows: DataFrame, key: str, blocks: str) -> DataFrame:
    """Deals the rows of each key to pairs of its ``blocks`` (a count): each row
    gets a block by its id and is sent once for every block, so any two rows meet
    in exactly one (group, _x, _y) and no group is larger than two blocks."""
    mine = F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")
    dealt = rows.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(
        F.lit(0), (F.col(blocks) - 1).cast("int"))))
    return (dealt.withColumn("_x", F.least("_mine", "_other")).withColumn("_y", F.greatest("_mine", "_other"))
            .withColumn("group", F.xxhash64(F.col(key), F.col("_x"), F.col("_y"))).drop("_other")
            .withColumn("_spot", F.xxhash64(F.lit(1), F.col(key)) % (1 << 40) + F.expr("_y * (_y + 1) div 2 + _x")))


def _by_group(rows: DataFrame) -> DataFrame:
    """Groups as runs of rows.  Those of one key go to partitions that follow one
    another, so no two of them meet in a task before all tasks have one."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartitionById(parts, F.pmod("_spot", F.lit(parts)).cast("int")).drop("_spot")
            .sortWithinPartitions("group", "id"))


def _sketch_links(rows: DataFrame, similarity: float) -> DataFrame:
    """Spanning forests of the pairs in each group whose sketches are near."""
    floor = similarity - SLACK * math.sqrt(similarity * (1 - similarity) / TOKENS)

    def run(batches):
        for part in groups(batches, "group"):
            if part.num_rows < 2:
                continue
            ids = part.column("id").to_numpy()
            mine = part.column("_mine").to_numpy()
            cross = part.column("_x")[0].as_py() != part.column("_y")[0].as_py()
            sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(-1, TOKENS)
            need = math.ceil(floor * TOKENS)

            def near(i, others):
                return (sketch[others] == sketch[i]).sum(axis=1) >= need

            edges = _bridges(mine, near) if cross else _forest(len(ids), near)
            if edges:
                a, b = ids[np.array(edges)].T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return _by_group(rows.select("_spot", "group", "_x", "_y", "_mine", "id", "sketch")).mapInArrow(run, EDGE)


def _only(sets: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """(id, column) of the sets that ``rows`` may need."""
    return may_match(sets.select("id", column), rows, "id").where("_may").drop("_may")


def _candidates(sets: DataFrame, similarity: float, recall: float) -> DataFrame:
    """Edges (a, b) proposed by the runs; ``sets``: (id, tokens, sketch), ids distinct."""
    level = _paths(sets, runs_for(recall, similarity, TOKENS, DEPTH), similarity)
    edges = None
    for depth in range(DEPTH):
        level = cut(level, "paths")
        sizes = level.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        # sets that share no path go here; the others fetch their sketches
        met = cut(level.join(sizes, "path"), "met")
        release(level)
        large = met.where(F.col("size") > SMALL)
        last = depth == DEPTH - 1 or large.isEmpty()
        now = (met if last else met.where(F.col("size") <= SMALL)).withColumn(
            "blocks", F.when(F.col("size") <= SMALL, 1).otherwise(F.ceil(F.col("size") / F.greatest(
                F.lit(SKETCHES[0]), F.least(F.lit(SKETCHES[1]), F.col("size") / 8)))).cast("int"))
        found = _sketch_links(_blocked(now, "path", "blocks").join(_only(sets, now, "sketch"), "id"), similarity)
        links = cut((found if edges is None else edges.unionByName(found)).distinct(), "links")
        if edges is not None:
            release(edges)
        edges = links
        if last:
            release(met)
            return edges
        level = _deeper(large.join(_only(sets, large, "tokens"), "id"), similarity)
    return edges


def _verify(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b, weight) for the groups of (group, _x, _y, _mine, id, weight,
    _text): ``weight`` rows (b null) count an id's links, edge rows (weight
    null) are a spanning forest of the verified pairs."""

    def run(batches):
        for part in groups(batches, "group"):
            g = part.num_rows
            if g < 2:
                continue
            values, first = shingle_sets(*joined_bytes(part.column("_text").combine_chunks()))
            size = np.diff(first)
            owner = np.repeat(np.arange(g), size)
            _, code = np.unique(values, return_inverse=True)
            shared = np.bincount(code) > 1
            at = shared[code]
            _, code = np.unique(code[at], return_inverse=True)
            common = np.zeros((g, g), dtype=np.float32)
            order = np.argsort(code, kind="stable")
            code, rows_ = code[order], owner[at][order]
            for lo in range(0, int(code[-1]) + 1 if len(code) else 0, 2048):  # bounded: g x 2048
                a, b = np.searchsorted(code, (lo, lo + 2048))
                block = np.zeros((g, 2048), dtype=np.float32)
                block[rows_[a:b], code[a:b] - lo] = 1
                common += block @ block.T
            linked = common >= similarity * (size[:, None] + size[None, :] - common) - 1e-6
            np.fill_diagonal(linked, False)

            def near(i, others, linked=linked):
                return linked[i, others]

            weight, ids = part.column("weight").to_numpy(), part.column("id").to_numpy()
            if part.column("_x")[0].as_py() != part.column("_y")[0].as_py():
                mine = part.column("_mine").to_numpy()
                edges = _bridges(mine, near)
                links = (linked & (mine[:, None] != mine[None, :])) @ weight
            else:
                edges, links = _forest(g, near), linked @ weight
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[some]), pa.nulls(len(some), pa.int64()), pa.array(links[some].astype(np.int64))],
                ["a", "b", "weight"])
            if edges:
                a, b = ids[np.array(edges)].T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "weight"])

    cols = ["_spot", "group", "_x", "_y", "_mine", "id", "weight", "_text"]
    return _by_group(rows.select(*cols)).mapInArrow(run, "a long, b long, weight long")


def near_groups(df: DataFrame, text: str, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(_uid, n_links, class_uid) for every row of ``df``, which must have a
    unique long ``_uid``: the number of other rows with a similarity of at least
    ``similarity``, and the least _uid of the row's connected group.

    Rows without words (null, empty, punctuation only) are linked to nothing.
    Equal texts and repeated rows are linked to each other.
    """
    with setting(df.sparkSession, DEALT):
        member, sets, signed = _grouped(df, text, similarity, recall)
    rows = hot_join(member, sets, "id", "weight").select(F.col("_id").alias("_uid"), "n_links", "class_uid")
    return rows.unionByName(signed.where("digest is null").select(
        F.col("_id").alias("_uid"), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("class_uid")))


def _grouped(df: DataFrame, text: str, similarity: float, recall: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: (_id, id) of the rows and their classes of equal sets, (id, weight,
    n_links, class_uid) of the classes, and the signed rows."""
    docs = df.select(F.col("_uid").alias("_id"), F.col(text).alias("_text"))
    signed = cut(_signed(docs), "signed")
    full = signed.where("digest is not null")
    equal = cut(full.groupBy("digest").agg(F.min("_id").alias("id"), F.count("*").alias("weight"),
                                           F.max("n").alias("n")), "classes")
    member = cut(hot_join(full.select("_id", "digest"), equal.select("digest", "id", "weight"), "digest", "weight")
                 .select("_id", "id"), "members")
    # few rows are copies: only what may be one is shuffled
    copies = member.where("_id <> id").select("_id")
    marked = may_match(full.select("_id", "tokens", "sketch"), copies, "_id")
    sets = cut(marked.where("not _may").unionByName(marked.where("_may").join(copies, "_id", "left_anti"))
               .select(F.col("_id").alias("id"), "tokens", "sketch"), "sets")
    edges = _candidates(sets, similarity, recall)
    comps = components(edges)
    release(sets, edges)
    found = comps.join(equal.select("id", "weight", "n"), "id")
    shape = found.groupBy("comp").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    size = F.greatest(F.lit(BLOCK[0]), F.least(F.lit(BLOCK[1]), F.col("sets") / 16))
    blocks = F.greatest(F.ceil(F.col("sets") / size), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    found = cut(found.join(shape.select("comp", blocks.cast("int").alias("blocks")), "comp"), "components")
    texts = may_match(docs.withColumnRenamed("_id", "id"), found, "id").where("_may").drop("_may").join(found, "id")
    verified = cut(_verify(_blocked(texts, "comp", "blocks"), similarity), "verified")
    release(found)
    links = verified.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("links"))
    near = components(verified.where("b is not null").select("a", "b")).select("id", "comp")
    classes = cut(equal.select("id", "weight").join(links, "id", "left").join(near, "id", "left").select(
        "id", "weight", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("comp", "id").alias("class_uid")), "groups")
    return member, classes, signed


def keep_one(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """``df`` with one row of each near-duplicate group: the first by ``id_col``
    (nulls last), ties by row.  All columns pass through."""
    inner, names = aliased(df)
    rows = cut(inner.select(*names, F.monotonically_increasing_id().alias("_uid")), "rows")
    body, order = (names[df.columns.index(c)] for c in (text, id_col))
    found = near_groups(rows, body)
    with setting(df.sparkSession, DEALT):
        found = cut(found.join(rows.select("_uid", order), "_uid"), "grouped")
        best = (found.groupBy("class_uid").agg(F.min(F.struct(F.col(order).isNull(), order, "_uid")).alias("m"))
                .select(F.col("m._uid").alias("_uid")))
        gone = cut(found.join(best, "_uid", "left_anti").select("_uid"), "gone")
    marked = may_match(rows, gone, "_uid")  # few rows go: only what may be gone is shuffled
    kept = marked.where("not _may").unionByName(
        marked.where("_may").join(gone.hint("shuffle_merge"), "_uid", "left_anti"))
    return restored(kept, df.columns)


def classes(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """(``id_col``, class_id, n_links) for every row: class_id is the least id of
    the row's near-duplicate group (null if all its ids are null).  Ids may be
    null or repeat: rows are told apart by a row id."""
    rows = cut(df.select(F.col(id_col).alias("_doc"), F.col(text).alias("_body"),
                         F.monotonically_increasing_id().alias("_uid")), "rows")
    found = near_groups(rows, "_body").join(rows.select("_uid", "_doc"), "_uid")
    with setting(df.sparkSession, DEALT):
        found = cut(found, "grouped")
        least = found.groupBy("class_uid").agg(F.min("_doc").alias("class_id"), F.count("*").alias("_n"))
        return cut(hot_join(found, cut(least, "least"), "class_uid", "_n").select(
            F.col("_doc").alias(id_col), "class_id", "n_links"), "named")


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """One row for each of ``documents``: its near-duplicate class (the least
    doc_id of its connected group) and its number of links."""
    return classes(table(spark, sf_dir, "documents"), "text", "doc_id")


_SHINGLES = r"""
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
"""

ORACLE_OP6 = "WITH RECURSIVE" + _SHINGLES + r"""
r AS (SELECT doc_id AS id, doc_id AS m FROM d UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.m),
k AS (SELECT id, min(m) AS class_id FROM r GROUP BY id),
c AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT d.doc_id, k.class_id, coalesce(c.n_links, 0) AS n_links FROM d JOIN k ON k.id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""
