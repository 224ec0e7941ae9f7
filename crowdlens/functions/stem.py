"""English (Porter2 / Snowball English) stemmer as built-in expressions.

Written from the published algorithm as a chain of steps: each is one SQL
expression over the values of the steps before, and no Python sees a word.
``stem_words`` applies the chain to a table of distinct words; ``stem_sql``
gives the same steps as nested selects.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the Snowball English algorithm, in its published order.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
R1_PREFIXES = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = ("c", "d", "e", "g", "h", "k", "m", "n", "r", "t")
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive",
    "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate",
    "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful",
    "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate",
    "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic",
    "ative": "", "ical": "ic", "ness": "", "ful": "",
}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti",
          "ous", "ive", "ize", "ion", "al", "er", "ic")

REGION = "[^aeiouy]*[aeiouy]+[^aeiouy]"  # up to the first non-vowel after a vowel
SHORT_END = "(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _drop(word: str, n: int | str) -> str:
    return f"left({word}, greatest(length({word}) - {n}, 0))"


def _suffix(word: str, suffixes) -> str:
    """The longest of ``suffixes`` at the end of the word, else ''."""
    return f"regexp_extract({word}, '({'|'.join(suffixes)})$', 1)"


def _ends(word: str, pattern: str) -> str:
    return f"regexp_like({word}, '{pattern}')"


def _mapped(suffix: str, table: dict[str, str]) -> str:
    return f"CASE {suffix} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + " END"


def _stages() -> list[tuple[str, str]]:
    """(column, expression) of each step, in order; the input is ``token``."""
    quote = "chr(39)"
    marked = "CASE WHEN left(w0, 1) = 'y' THEN concat('Y', substr(w0, 2)) ELSE w0 END"
    for vowel in "aeiouy":  # a y after a vowel is a consonant, written Y
        marked = f"replace({marked}, '{vowel}y', '{vowel}Y')"
    first = f"^({'|'.join(R1_PREFIXES)}|{REGION})"
    after_ing = (f"CASE WHEN {_ends('b4', '(at|bl|iz)$')} THEN concat(b4, 'e') "
                 f"WHEN {_ends('b4', '(' + '|'.join(DOUBLES) + ')$')} THEN {_drop('b4', 1)} "
                 f"WHEN r1 >= length(b4) AND {_ends('b4', SHORT_END)} THEN concat(b4, 'e') ELSE b4 END")
    plain_2 = {k: v for k, v in STEP_2.items() if k not in ("ogi", "li")}
    return [
        ("w0", f"CASE WHEN left(token, 1) = {quote} THEN substr(token, 2) ELSE token END"),
        ("w1", marked),
        ("r1", f"coalesce(nullif(length(regexp_extract(w1, '{first}', 0)), 0), length(w1))"),
        ("r2", f"r1 + coalesce(nullif(length(regexp_extract(substr(w1, r1 + 1), '^{REGION}', 0)), 0), "
               "length(w1) - r1)"),
        # step 0: possessive endings
        ("w2", f"CASE WHEN right(w1, 3) = concat({quote}, 's', {quote}) THEN {_drop('w1', 3)} "
               f"WHEN right(w1, 2) = concat({quote}, 's') THEN {_drop('w1', 2)} "
               f"WHEN right(w1, 1) = {quote} THEN {_drop('w1', 1)} ELSE w1 END"),
        # step 1a: plurals
        ("w3", f"CASE WHEN w2 LIKE '%sses' THEN {_drop('w2', 2)} "
               f"WHEN w2 LIKE '%ied' OR w2 LIKE '%ies' THEN "
               f"{_drop('w2', 'CASE WHEN length(w2) > 4 THEN 2 ELSE 1 END')} "
               "WHEN w2 LIKE '%us' OR w2 LIKE '%ss' THEN w2 "
               f"WHEN w2 LIKE '%s' AND {_ends(_drop('w2', 2), '[aeiouy]')} THEN {_drop('w2', 1)} "
               "ELSE w2 END"),
        # step 1b: past and continuous forms
        ("x4", _suffix("w3", ("eedly", "ingly", "edly", "eed", "ing", "ed"))),
        ("b4", _drop("w3", "length(x4)")),
        ("w4", "CASE WHEN x4 IN ('eedly', 'eed') THEN "
               "CASE WHEN length(b4) >= r1 THEN concat(b4, 'ee') ELSE w3 END "
               f"WHEN x4 <> '' AND {_ends('b4', '[aeiouy]')} THEN {after_ing} ELSE w3 END"),
        # step 1c: final y after a consonant
        ("w5", f"CASE WHEN {_ends('w4', '.[^aeiouy][yY]$')} THEN concat({_drop('w4', 1)}, 'i') ELSE w4 END"),
        ("x6", _suffix("w5", STEP_2)),
        ("b6", _drop("w5", "length(x6)")),
        ("w6", "CASE WHEN x6 = '' OR length(b6) < r1 THEN w5 "
               "WHEN x6 = 'ogi' THEN CASE WHEN right(b6, 1) = 'l' THEN concat(b6, 'og') ELSE w5 END "
               f"WHEN x6 = 'li' THEN CASE WHEN right(b6, 1) IN {_in(LI_ENDINGS)} THEN b6 ELSE w5 END "
               f"ELSE concat(b6, {_mapped('x6', plain_2)}) END"),
        ("x7", _suffix("w6", STEP_3)),
        ("b7", _drop("w6", "length(x7)")),
        ("w7", "CASE WHEN x7 = '' OR length(b7) < r1 OR (x7 = 'ative' AND length(b7) < r2) THEN w6 "
               f"ELSE concat(b7, {_mapped('x7', STEP_3)}) END"),
        ("x8", _suffix("w7", STEP_4)),
        ("b8", _drop("w7", "length(x8)")),
        ("w8", "CASE WHEN x8 = '' OR length(b8) < r2 "
               "OR (x8 = 'ion' AND right(b8, 1) NOT IN ('s', 't')) THEN w7 ELSE b8 END"),
        # step 5: final e and l
        ("b9", _drop("w8", 1)),
        ("w9", "CASE WHEN right(w8, 1) = 'e' THEN CASE WHEN length(b9) >= r2 "
               f"OR (length(b9) >= r1 AND NOT {_ends('b9', SHORT_END)}) THEN b9 ELSE w8 END "
               "WHEN right(w8, 2) = 'll' AND length(b9) >= r2 THEN b9 ELSE w8 END"),
        ("term", "CASE WHEN token IS NULL OR length(token) <= 2 THEN token "
                 + " ".join(f"WHEN token = '{a}' THEN '{b}'" for a, b in EXCEPTIONS.items())
                 + f" WHEN w3 IN {_in(KEPT_AFTER_1A)} THEN w3 ELSE replace(w9, 'Y', 'y') END"),
    ]


def stem_words(words: DataFrame, method: str = "porter2") -> DataFrame:
    """``(token, term)`` for each row of ``words`` (column ``token``, lower case):
    ``none`` keeps the token, ``porter2`` stems it.  Null gives null."""
    if method == "none":
        return words.select("token", F.col("token").alias("term"))
    if method != "porter2":
        raise ValueError(f"unknown stemmer {method!r}")
    return words.select("token", F.expr(_chained()).alias("term"))


def _chained() -> str:
    """The steps as one expression.  The values so far are fields of a struct
    bound by a one-element ``transform``: as plain projections the optimiser
    would put every step into each later use of it, which grows without bound."""
    names, chain = ["token"], "named_struct('token', token)"
    for column, expression in _stages():
        bound = re.sub(r"\b(token|[wxb]\d|r\d)\b", r"s.\1", expression)
        kept = ", ".join(f"'{n}', s.{n}" for n in names)
        chain = f"element_at(transform(array({chain}), s -> named_struct({kept}, '{column}', {bound})), 1)"
        names.append(column)
    return f"({chain}).term"


def stem_sql(src: str) -> str:
    """The same steps as nested selects over ``src``: ``token, term``."""
    sql = f"select token from {src}"
    for column, expression in _stages():
        sql = f"select *, {expression.replace('regexp_like', 'regexp_matches')} as {column} from ({sql})"
    return f"select token, term from ({sql})"
