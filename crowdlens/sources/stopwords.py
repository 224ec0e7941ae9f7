"""Stop words (IO8) and the stop-word source reader.

The default list is the reference program's English list: 174 words plus
one empty entry (its file ends with a blank line), so the empty token is a
stop word too.  Callers may read their own list with ``read_stopwords``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The default English stop-word list, in its original order.
_DEFAULT_STOP_WORDS = """
    a about above after again against all am an and any are aren't as at be because
    been before being below between both but by can't cannot could couldn't did didn't
    do does doesn't doing don't down during each few for from further had hadn't has
    hasn't have haven't having he he'd he'll he's her here here's hers herself him
    himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself
    let's me more most mustn't my myself no nor not of off on once only or other ought
    our ours ourselves out over own same shan't she she'd she'll she's should shouldn't
    so some such than that that's the their theirs them themselves then there there's
    these they they'd they'll they're they've this those through to too under until up
    very was wasn't we we'd we'll we're we've were weren't what what's when when's
    where where's which while who who's whom why why's with won't would wouldn't you
    you'd you'll you're you've your yours yourself yourselves
"""

STOP_WORDS: tuple[str, ...] = tuple(_DEFAULT_STOP_WORDS.split()) + ("",)


def stopwords_df(spark: SparkSession, words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """The stop list as a one-column DataFrame (small, fixed size: broadcast)."""
    return spark.createDataFrame([(w,) for w in words], "word string")


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """IO8: one word per line; a blank line contributes the empty word."""
    return spark.read.text(path).select(F.col("value").alias("word")).distinct()
