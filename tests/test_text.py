from pyspark.sql import functions as F

from crowdlens.functions import text as T
from crowdlens.operators import vocab as V

TOKENS_IN = "<b>Hi</b> $5 at http://x.io/1?a, mail bob1@x.com or @ann! don't a\nb café"
TOKENS_OUT = "hi dollarnumber at httpaddr mail emailaddr or username don t ab caf".split()


def test_tokens_hand_fixture(spark):
    df = spark.createDataFrame([("t", TOKENS_IN)], "task_id string, body_text string")
    toks = [r.token for r in V.tokens(df, "task_id").orderBy("pos").collect()]
    assert toks == TOKENS_OUT


def test_split_keeps_empty_parts(spark):
    df = spark.createDataFrame([(".a..b.",)], "x string")
    parts = df.select(T.split_parts(F.col("x")).alias("p")).first().p
    assert parts == ["", "a", "", "b", ""]


def test_stop_words_before_stemming(spark):
    df = spark.createDataFrame([("1", "The having of runs")], "task_id string, body_text string")
    terms = [r.term for r in V.vocab_terms(df, "task_id", stem="porter2").orderBy("pos").collect()]
    assert terms == ["run"]  # 'the', 'having', 'of' are stop words


def test_negative_idf_and_zero_vector(spark):
    from tests.conftest import make_ann
    ann = make_ann(spark, [("w", "1", 0, "alpha beta", None), ("w", "2", 0, "alpha", None),
                           ("w", "3", 0, "the of", None)])
    stats = V.term_stats(ann, stem="none")
    idf = {r.term: r.idf for r in V.idf(stats).collect()}
    # N = 3 documents; alpha in 2 -> ln(3/3) = 0, beta in 1 -> ln(3/2)
    assert abs(idf["alpha"]) < 1e-12 and abs(idf["beta"] - 0.4054651) < 1e-6
    w = {(r.doc_order, r.term): r.weight for r in V.tfidf_l2(stats).collect()}
    assert w[(1, "alpha")] is None  # zero vector -> NULL, not NaN


def test_text_checks(spark):
    from crowdlens.operators.quality import text_checks
    from tests.conftest import make_ann
    ann = make_ann(spark, [("w", "1", 0, "  ", None), ("w", "2", 0, "123 !!", None),
                           ("w", "3", 0, "x" * 10001, None)])
    rows = {r.row_id: r for r in text_checks(ann).collect()}
    assert rows[0].is_blank and not rows[1].is_blank
    assert rows[1].has_letters is False and rows[1].clean_length == 0
    assert rows[2].is_long


def test_one_pass_tokens_equal_split_then_strip(spark):
    import random
    rnd = random.Random(7)
    alphabet = list("abcXYZ019 \t\n\r") + list(T.DELIMITERS) + ["é", "ß", "漢", " ", "😀", "|", "~", "^"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 60))) for _ in range(500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    one = df.select("id", T.token_parts(F.col("t")).alias("a"))
    two = df.select("id", F.transform(T.split_parts(F.col("t")), T.strip_token).alias("b"))
    rows = one.join(two, "id").collect()
    assert len(rows) == 500
    assert all(r.a == r.b for r in rows)


def test_stop_words_in_index_path_option(spark):
    from tests.conftest import make_ann
    # 'haves' puts the stem 'have' in the vocabulary; 'having' is a stop word
    # whose stem is also 'have': indexed by default, dropped with the option
    ann = make_ann(spark, [("w", "1", 0, "haves", None), ("w", "2", 0, "having", None)])
    vocab = V.vocabulary(ann, stem="porter2")
    assert [r.term for r in vocab.collect()] == ["have"]
    default = {r.task_id for r in V.task_words(ann, vocab).collect()}
    strict = {r.task_id for r in V.task_words(ann, vocab, apply_stop_in_index=True).collect()}
    assert default == {"1", "2"} and strict == {"1"}


def test_read_stopwords_keeps_blank_entry(spark):
    from crowdlens.session import scratch_path
    from crowdlens.sources.stopwords import STOP_WORDS, read_stopwords
    path = scratch_path(spark, "stop")
    spark.createDataFrame([("a",), ("the",), ("",)], "value string").coalesce(1).write.text(path)
    words = {r.word for r in read_stopwords(spark, path).collect()}
    assert words == {"a", "the", ""}
    assert len(STOP_WORDS) == 175 and STOP_WORDS[-1] == ""
