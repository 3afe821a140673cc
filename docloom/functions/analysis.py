"""Text analysis with built-in functions: word tokens in lower case, without stop words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: letters, digits and underscores, joined by single apostrophes or full stops.
TOKEN = r"[\p{L}\p{N}_]+(?:['.][\p{L}\p{N}_]+)*"

#: The standard English stop words of the analyser whose results are to be matched.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not",
    "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)
LONGEST = 255


def all_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def tokens(text: Column) -> Column:
    return F.filter(all_tokens(text), lambda t: ~t.isin(*STOP_WORDS) & (F.length(t) <= LONGEST))
