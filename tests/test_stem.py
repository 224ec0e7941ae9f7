import random

import duckdb
import pytest

from crowdlens.functions.stem import stem_sql, stem_words
from tests.plain_stem import stem

# Published Snowball English examples (word -> stem).
PAIRS = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed",
    "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
    "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz",
    "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "skies": "sky",
    "relational": "relat", "generously": "generous", "consign": "consign",
    "consigned": "consign", "consistency": "consist", "knightly": "knight",
    "fine": "fine", "good": "good", "dying": "die", "news": "news", "gas": "gas",
    "gaps": "gap", "kiwis": "kiwi", "cry": "cri", "by": "by", "say": "say",
    "proceed": "proceed", "exceeding": "exceed", "generate": "generat",
    "communication": "communic", "hopeful": "hope", "goodness": "good",
    "electrical": "electr", "adjustment": "adjust", "controllable": "control",
    "rolling": "roll", "abandoned": "abandon", "abilities": "abil", "running": "run",
}
ENDINGS = ("ed ing edly ingly eed eedly s ies ied sses us ss 's ' 's' ization ational ousness li ogi logi alli "
           "ative ness ful ement ment ent ion sion tion e l ll y yy al er ic able").split()


def made_words(n: int) -> list[str]:
    rnd = random.Random(3)
    out = []
    for _ in range(n):
        body = "".join(rnd.choice("aeiouybcdghlmnrstwxz") for _ in range(rnd.randrange(0, 8)))
        out.append(body + "".join(rnd.choice(ENDINGS) for _ in range(rnd.randrange(0, 3))))
    return [*PAIRS, "", "at", "y", "yy", "yyy", "'", "''", "'s", "a's", "inning", "succeeds", "generally", "arsenal",
            "number", "numberth", "7up", "sayyid", "byyyx", *out]


@pytest.fixture(scope="module")
def stems(spark):
    words = spark.createDataFrame([(w,) for w in [*dict.fromkeys(made_words(4000)), None]], "token string")
    return {r.token: r.term for r in stem_words(words).collect()}


def test_published_pairs(stems):
    assert {w: stems[w] for w in PAIRS} == PAIRS


def test_equals_one_word_at_a_time(stems):
    assert {w: t for w, t in stems.items() if t != stem(w)} == {}
    assert stems[None] is None


def test_sql_gives_the_same(stems):
    con = duckdb.connect()
    con.execute("create table words (token varchar)")
    con.executemany("insert into words values (?)", [[w] for w in stems])
    assert dict(con.execute(stem_sql("words")).fetchall()) == stems


def test_unknown_stemmer_is_refused(spark):
    words = spark.createDataFrame([("cats",)], "token string")
    assert stem_words(words, "none").first().term == "cats"
    with pytest.raises(ValueError, match="stemmer"):
        stem_words(words, "other")
