"""The stages of the pipeline: schema, decisions and rows, each against a version
that looks at one text at a time."""

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
import corpus_pipeline
from crowdlens.llm import decontam, langid, packing, queries, secrets
from tests import oracle_check
from tests.llm.test_operators import brute_secrets, words_of

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_rows(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (900_001, "12 34", "en", "src0", 5)], source.schema)
    docs = source.unionByName(odd).unionByName(source.limit(5))  # nulls, no letters, repeated rows
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = kept[name] = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == source.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == list(kept)
    n = {k: v.count() for k, v in kept.items()}
    assert n["language_id"] >= source.count()  # repeated rows stay, the two odd ones go
    assert kept["language_id"].where("doc_id is null or doc_id = 900001").count() == 0
    assert n["near_duplicates"] <= source.count()
    assert n["near_duplicates"] == kept["near_duplicates"].select("doc_id").distinct().count()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    hits = decontam.spans_of(kept["decontamination"], bench, "text", ["doc_id"]).where("n_hit > 0").count()
    assert hits == 0
    assert n["secret_scan"] == n["decontamination"]
    assert kept["secret_scan"].where("n_chars <> length(text)").count() == 0
    words = lambda df, c: sum(len((r[0] or "").split()) for r in df.select(c).collect())
    assert words(kept["secret_scan"], "text") == words(kept["packing"], "chunk_text")


@pytest.fixture(scope="module")
def source(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_stage_equals_one_text_at_a_time(spark, source):
    model = langid.train(source, "text", "lang", "doc_id")
    wanted = set()
    for row in source.collect():
        low = (row.text or "").lower()
        b = langid.words_of(pa.array([low]))
        scores = model.words(b)
        value, back = np.zeros(len(model.languages)), []
        for word in scores:  # one word at a time, no batch
            stay = [(value[k], k) if value[k] >= value.max() - langid.SWITCH else (value.max() - langid.SWITCH, int(value.argmax()))
                    for k in range(len(value))]
            back.append([k for _, k in stay])
            value = np.array([v for v, _ in stay]) + word
        share, at = np.zeros(len(model.languages)), int(value.argmax()) if len(scores) else 0
        for i in range(len(scores) - 1, -1, -1):
            share[at] += b.size[i]
            at = back[i][at]
        if share.sum() and share.max() / share.sum() >= corpus_pipeline.MIN_LANGUAGE_SCORE:
            wanted.add(row.doc_id)
    got = corpus_pipeline.language(spark, source, SF)
    assert {r.doc_id for r in got.collect()} == wanted


def test_near_duplicate_stage_equals_all_pairs(spark, source):
    rows = source.collect()
    sets = []
    for r in rows:
        w = words_of(r.text)
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))
    root = lambda i: i if up[i] == i else root(up[i])
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r.doc_id), r.doc_id)
    got = corpus_pipeline.near_duplicates(spark, source, SF).collect()
    assert {r.doc_id for r in got} == set(least.values()) and len(got) < len(rows)


def test_decontamination_stage_equals_one_text_at_a_time(spark, source):
    items = [words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i:i + 10]) for w in items for i in range(len(w) - 9)} | {tuple(w) for w in items if 0 < len(w) < 10}
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wanted, changed = {}, 0
    for r in source.collect():
        text = r.text or ""
        found = [(m.start(), m.end()) for m in pattern.finditer("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))]
        words, hit = words_of(text), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if tuple(words[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
        if len(hit) > decontam.MAX_COVERAGE * len(words):
            continue
        out, at, i = "", 0, 0
        while i < len(words):
            j = i
            while j in hit:
                j += 1
            if j - i >= 10:
                out, at = out + text[at:found[i][0]], found[j - 1][1]
            i = max(j, i + 1)
        wanted[r.doc_id] = out + text[at:] if r.text is not None else None
        changed += at > 0
    got = {r.doc_id: r.text for r in corpus_pipeline.decontaminate(spark, source, SF).collect()}
    assert got == wanted and changed > 0


def test_secret_stage_equals_one_text_at_a_time(spark, source):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in source.collect()]
    wanted = {}
    for row, spans in zip(rows, brute_secrets(rows)):
        out, at = "", 0
        for start, _, end, _, live in spans:
            if live:
                if start >= at:
                    out += row[1][at:start] + "<SECRET>"
                at = max(at, end)
        wanted[row[0]] = out + row[1][at:] if row[1] is not None else None
    got = {r.doc_id: r.text for r in corpus_pipeline.redact_secrets(spark, source, SF).collect()}
    assert got == wanted and any("<SECRET>" in (t or "") for t in got.values())


def test_packing_stage_equals_one_text_at_a_time(spark, source):
    got = corpus_pipeline.pack(spark, source, SF).collect()
    chunks = []
    for r in source.collect():
        starts = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", r.text or "")]
        cuts = [0, *starts[packing.MAX_TOKENS::packing.MAX_TOKENS], len(r.text or "")]
        chunks += [(r.doc_id, i, (r.text or "")[a:b], len(starts[i * packing.MAX_TOKENS:(i + 1) * packing.MAX_TOKENS]))
                   for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r.doc_id, r.chunk, r.chunk_text, r.n_tokens) for r in got) == sorted(chunks)
    n, count = np.unique([c[3] for c in chunks], return_counts=True)
    tops = packing.optimal_buckets(n, count, packing.BUCKETS)
    placed = {}
    for doc, chunk, _, tokens in sorted(chunks):
        bucket = next(i for i, top in enumerate(tops) if tokens <= top)
        placed.setdefault(bucket, []).append((doc, chunk))
    for bucket, held in placed.items():
        fit = max(1, packing.BUDGET // max(tops[bucket], 1))
        want = [(doc, chunk, i // fit, i % fit) for i, (doc, chunk) in enumerate(held)]
        assert sorted((r.doc_id, r.chunk, r.batch, r.slot) for r in got if r.bucket == bucket) == sorted(want)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.op4_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    held = rows.where("held_out").collect()
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_queries_equal_their_sql(spark):
    found = oracle_check.compare(spark, SF, sorted(queries.ORACLE))
    assert all(r.get("match") for r in found.values()), found


def test_every_query_is_registered():
    found = __spark_entry__.queries()
    assert {k.split("_")[0] for k in found if k.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in found and set(queries.ORACLE) <= set(__spark_entry__.oracle_sql())
    assert secrets.BASE == 3
