"""Text cleaning and tokenisation as Column expressions.

All steps are built-in ``regexp_replace`` / ``split`` expressions, so they
stay inside whole-stage code generation; no Python runs per row.  The order
of the steps matters (each sees the output of the one before): numbers are
replaced before URLs, so a URL's digits are already the word ``number``.

Java regular expressions: ``(?U)`` makes ``\\s`` mean Unicode white space,
which is what the reference's regex engine uses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cleaning rules, in the order they are applied.
HTML_TAG = r"<[^<>]+>"                    # removed
NUMBER = r"[0-9]+"                        # -> "number"
URL = r"(?U)(http|https)://[^\s]*"        # -> "httpaddr"
EMAIL = r"(?U)[^\s]+@[^\s]+"              # -> "emailaddr"
DOLLAR = r"[$]+"                          # -> "dollar"
USERNAME = r"(?U)@[^\s]+"                 # -> "username"
# Token delimiters (tab and newline are not delimiters):
# space @ $ / # . - : & * + = [ ] ? ! ( ) { } , ' " > _ < ; % \
DELIMITERS = " @$/#.-:&*+=[]?!(){},'\">_<;%\\"
NON_ALNUM = r"[^a-zA-Z0-9]"               # stripped from every token
NON_LETTER_OR_SPACE = r"(?U)[^a-zA-Z\s]"  # quality check F12
LONG_TEXT = 10000                         # quality check F13 / V9


def _char_class(chars: str) -> str:
    escaped = "".join("\\" + c if c in "[]\\-^&" else c for c in chars)
    return "[" + escaped + "]"


SPLIT_PATTERN = _char_class(DELIMITERS)
# every character that is neither kept by F9 nor a delimiter of F8
DROPPED = "[^a-zA-Z0-9" + SPLIT_PATTERN[1:]


def clean(text: Column) -> Column:
    """Lower-case, strip tags, replace numbers, URLs, e-mails, $, @names."""
    t = F.lower(text)
    t = F.regexp_replace(t, HTML_TAG, "")
    t = F.regexp_replace(t, NUMBER, "number")
    t = F.regexp_replace(t, URL, "httpaddr")
    t = F.regexp_replace(t, EMAIL, "emailaddr")
    t = F.regexp_replace(t, DOLLAR, "dollar")
    t = F.regexp_replace(t, USERNAME, "username")
    return t


def split_parts(cleaned: Column) -> Column:
    """F8: split on the delimiter set, keeping empty parts."""
    return F.split(cleaned, SPLIT_PATTERN, -1)


def strip_token(part: Column) -> Column:
    """remove everything but ASCII letters and digits."""
    return F.regexp_replace(part, NON_ALNUM, "")


def token_parts(cleaned: Column) -> Column:
    """F8 + F9 in one pass over the text: characters that F9 would strip and
    that are not delimiters are removed before the split, which leaves every
    part (and its position) exactly as splitting then stripping would."""
    return F.split(F.regexp_replace(cleaned, DROPPED, ""), SPLIT_PATTERN, -1)


def is_blank(c: Column) -> Column:
    """NULL, empty or white space only."""
    return c.isNull() | c.rlike(r"(?U)^\s*$")


def letters_only_length(text: Column) -> Column:
    """length of the text with non-letters removed and ends trimmed."""
    kept = F.regexp_replace(text, NON_LETTER_OR_SPACE, "")
    return F.length(F.regexp_replace(kept, r"(?U)^\s+|\s+$", ""))


def has_letters(text: Column) -> Column:
    return text.rlike("[a-zA-Z]")
