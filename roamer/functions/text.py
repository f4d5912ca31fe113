"""Text expressions: tokens, stop words, n-grams, hashed buckets (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roamer.functions.numeric import col_of

# Lower-cased runs of two or more word characters.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
TOKEN_PATTERN_RE2 = r"[\pL\pN_]{2,}"

# Our own English stop list (shared with the oracle SQL).
STOP_WORDS = sorted(set("""
a about above after again against all also am an and any are as at be because been before
being below between both but by can could did do does doing down during each few for from
further had has have having he her here hers herself him himself his how i if in into is it
its itself just me more most my myself no nor not now of off on once only or other our ours
ourselves out over own same she should so some such than that the their theirs them
themselves then there these they this those through to too under until up very was we were
what when where which while who whom why will with would you your yours yourself yourselves
""".split()))

DIMENSIONS = 1536


def tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(col_of(text)), F.lit(TOKEN_PATTERN), 0)


def drop_stop_words(toks) -> Column:
    return F.filter(col_of(toks), lambda t: ~t.isin(*STOP_WORDS))  # a hash-set lookup a token


def ngrams_1_2(toks) -> Column:
    """Unigrams followed by space-joined adjacent bigrams.

    Pass a column reference (stage the tokens first): the array is read a few
    times, never inside a per-element lambda.
    """
    t = col_of(toks)
    n = F.size(t)
    bigrams = F.zip_with(F.slice(t, 1, n - 1), F.slice(t, 2, n - 1),
                         lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n >= 2, F.concat(t, bigrams)).otherwise(t)


def bucket(gram, dims: int = DIMENSIONS) -> Column:
    """Stable hashed bucket: first 32 bits of md5, modulo ``dims``."""
    return F.pmod(F.conv(F.substring(F.md5(col_of(gram)), 1, 8), 16, 10).cast("long"), F.lit(dims))


def title_case(text) -> Column:
    """Upper case after any character that is no letter (and at the start), lower case elsewhere."""
    chars = F.split(col_of(text), "")
    one = lambda c, i: F.when((i == 0) | ~F.get(chars, i - 1).rlike(r"\p{L}"), F.upper(c)).otherwise(F.lower(c))
    return F.array_join(F.transform(chars, one), "")
