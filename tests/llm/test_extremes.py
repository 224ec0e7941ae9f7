"""All operators on tables with nulls in every column, very long texts, repeated
rows and columns named like internal ones, and on empty tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crowdlens.llm import chat, decontam, fingerprint, langid, licenses, packing, queries

PASSAGE = " ".join(f"passage{i}" for i in range(30))
LONG = (" ".join(f"word{i % 5003} über" for i in range(120_000)) + f"\n{PASSAGE}\nReleased under the MIT License.\n"
        "token: aB3xxxxxxxxxxxxxxxxx\n" + "0123456789abcdef " * 3000)
NAMES = ("_uid _text _id _mask _leaf shard slot n_words n_hit spans items licenses chunk fingerprint lang_pred score "
         "n_links class_id kept size key weight comp opening _rank").split()
SHAPES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
    "embeddings": "vec_id long, embedding array<float>, label int", "pages": "page_id long, url string, html string"}
ROWS = {
    "documents": [(1, LONG, "en", "a", 1), (2, LONG, "en", "a", 1), (3, None, "en", None, None), (4, "", None, "b", 0),
                  (None, "short text", "fr", "b", 3), (5, "one line", "en", "a", 8), (5, "one line", "en", "a", 8),
                  (None, None, None, None, None), (6, " \t\n \x00 ", "", "", 0), (7, "Дом и сад", "ru", "c", 9)],
    "benchmark": [(1, PASSAGE), (1, PASSAGE), (2, None), (None, PASSAGE), (3, "!!"), (4, "")],
    "labels": [(1, 1, 0), (2, None, 1), (None, 1, 1), (5, 1, None), (5, 0, 0), (99, 1, 1)],
    "conversations": [(1, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(2000)] + [
        (2, 0, "assistant", "turn 0"), (2, 1, "user", LONG), (2, 1, "user", LONG), (None, None, None, None), (3, 0, None, "")],
    "embeddings": [(0, [0.5, 0.5], 1), (0, [0.5, 0.5], 1), (1, [0.5, 0.4], 1), (2, [0.2, 0.2], 2), (3, None, 1),
                   (None, [0.1, 0.3], 3), (100, [], 2), (200, [1e30, None], 1), (300, [0.25, 0.25], None)],
    "pages": []}


def tables(spark, folder, rows):
    for name, shape in SHAPES.items():
        df = spark.createDataFrame(rows[name], shape)
        extra = [F.lit(7).alias(c) for c in NAMES if c not in df.columns]
        df.select("*", *extra).repartition(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def extreme(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("extreme"), ROWS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("empty"), dict.fromkeys(SHAPES, []))


QUERIES = {**queries.QUERIES, "pipeline": corpus_pipeline.run}
PER_DOCUMENT = ("op1_", "op2_", "op4_", "op5_", "op6_", "op8_", "op9_", "op10_", "op11_")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_extreme_tables(spark, extreme, name):
    got = QUERIES[name](spark, extreme).collect()
    if name.startswith(PER_DOCUMENT):
        assert sorted((r.doc_id for r in got), key=str) == sorted((r[0] for r in ROWS["documents"]), key=str)
    by = {r.doc_id: r for r in got if hasattr(r, "doc_id")}
    size = len(LONG.encode())
    if name.startswith("op1_"):
        assert by[1].n_removed > 0 and (by[2].n_bytes, by[2].n_removed) == (size, size)
        assert by[2].kept_sha256 == by[3].kept_sha256 == hashlib.sha256(b"").hexdigest()
    elif name.startswith("op2_"):
        assert by[1].n_hit == 30 and by[1].n_items == 1 and by[1].n_words == 240_000 + 30 + 5 + 2 + 3000
    elif name.startswith("op5_"):
        assert by[1].names == "MIT"
    elif name.startswith("op6_"):
        assert by[2].class_id == 1 and by[2].n_links == 1 and by[5].n_links == 1
    elif name.startswith("op7_"):
        assert sum(r.n_tokens for r in got if r.doc_id == 1) == len(LONG.split())
    elif name.startswith("op8_"):
        assert by[1].n_words == len(LONG.split()) and by[3].base_failed
    elif name.startswith("op9_"):
        assert (by[1].n_assign, by[1].n_hex) == (1, 3000)
    elif name.startswith("op10_"):
        assert sorted(r.size for r in got)[-2:] == [size + 1] * 2 and {r.shard for r in got} <= set(range(8))
    elif name.startswith("op11_"):
        assert by[1].n_chars == len(LONG) and by[1].fingerprint == by[2].fingerprint and by[1].near_next == 1.0
    elif name.startswith("op12_"):
        assert {r.anchor_id for r in got} <= {0, 100}
    elif name.startswith("op13_"):
        assert {r.part for r in got} == {"", "a", "b", "c"} and len(got) == 4 * 600
    elif name.startswith("op3_"):
        assert {r.chosen_id for r in got} | {r.rejected_id for r in got if r.paired} == {1, 2, 3, None}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    got = QUERIES[name](spark, empty)
    assert got.columns and got.collect() == []


def test_kept_columns_with_taken_names_are_refused(spark, extreme):
    docs = spark.read.parquet(f"{extreme}/documents.parquet")
    bench = spark.read.parquet(f"{extreme}/benchmark.parquet")
    model = langid.Model([], None, None)
    for run in (lambda: licenses.scan(docs, "text", ["licenses"]), lambda: langid.predict(docs, "text", ["score"], model),
                lambda: decontam.spans_of(docs, bench, "text", ["n_hit"]), lambda: packing.chunks(docs, "text", ["chunk"]),
                lambda: fingerprint.fingerprints(docs, "text", ["fingerprint"]),
                lambda: licenses.scan(docs, "text", ["doc_id", "doc_id"]),
                lambda: chat.format_preferences(docs.withColumn("prompt", F.lit(1)), ["prompt"])):
        with pytest.raises(ValueError, match="taken"):
            run()
