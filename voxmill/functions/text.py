"""Text expressions: trimming, keys, tokens and n-grams."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space in Unicode, plus the four ASCII separators.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Word characters as a character-class body. The engine's own \w and \b differ between regex
# dialects on accented letters, so patterns spell the class out.
WORD = r"\p{L}\p{N}_"

# Domain words that never name a theme.
DOMAIN_STOPWORDS = (
    "app", "apps", "application", "please", "pls", "just", "really", "very", "get", "got", "use", "using", "used",
    "would", "could", "also", "one", "even", "thing", "things", "doesn", "didn", "isn", "wasn", "don", "won",
    "couldn", "wouldn", "shouldn", "cant", "dont", "doesnt", "didnt", "ive", "im", "hasn", "haven", "aren", "like",
    "make", "makes", "need", "want", "time", "times", "ever", "lot", "much",
)


def strip(c: Column) -> Column:
    """Null-safe trim of all Unicode white space: null becomes the empty string."""
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(WHITESPACE))


def text_key(c: Column) -> Column:
    """Near-duplicate key: lower-case, runs of anything but a-z and 0-9 become one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def unicode_boundaries(pattern: str) -> str:
    """Rewrite a leading or trailing word boundary as a look-around on the full Unicode word class."""
    out = pattern
    if out.startswith(r"\b"):
        out = f"(?<![{WORD}])" + out[2:]
    if out.endswith(r"\b"):
        out = out[:-2] + f"(?![{WORD}])"
    return out


@lru_cache(maxsize=None)
def _spark_english() -> tuple[str, ...]:
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


def english_stopwords(extra: Iterable[str] = ()) -> list[str]:
    """Spark's English list, cut at apostrophes as the tokeniser does, plus ``extra``."""
    pieces = {p for w in _spark_english() for p in w.lower().split("'") if len(p) > 1}
    return sorted(pieces | set(extra))


def theme_stopwords(custom: Iterable[str] | None = None) -> list[str]:
    return sorted(set(custom)) if custom is not None else english_stopwords(DOMAIN_STOPWORDS)


def words(c: Column) -> Column:
    """Lower-cased maximal runs of word characters."""
    return F.split(F.lower(c), f"[^{WORD}]+")


def term_tokens(c: Column, stopwords: list[str]) -> Column:
    """Tokens that can be part of a theme name: a letter, then letters or digits, no stop word."""
    whole = f"(?<![{WORD}])[a-z][a-z0-9]+(?![{WORD}])"
    tokens = F.regexp_extract_all(F.lower(c), F.lit(whole), F.lit(0))
    return F.filter(tokens, lambda t: ~t.isin(stopwords)) if stopwords else tokens


def feature_tokens(c: Column, stopwords: list[str]) -> Column:
    """Tokens for hashed features: at least two word characters, no stop word."""
    return F.filter(words(c), lambda t: (F.length(t) >= 2) & ~t.isin(stopwords))


def bigrams(tokens: Column) -> Column:
    """Neighbouring pairs; formed after stop words are gone, so they may bridge removed words."""
    following = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1)))
    pairs = F.zip_with(tokens, following, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(pairs, lambda p: p.isNotNull())


def utf16_length(c: Column) -> Column:
    return (F.length(F.encode(c, "UTF-16BE")) / 2).cast("int")
