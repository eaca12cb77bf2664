"""Text column expressions.

Tokens are cut at the full Unicode white-space set, so the counts do not depend
on the regular-expression dialect.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# White space, decimal digits incl. super/subscript digits, upper case.
WHITESPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]"
CAPITALISED = r"(?s)^\p{Lu}."


def strip(text: Column) -> Column:
    """Remove white space at both ends (all Unicode white space, not only blanks)."""
    return F.regexp_replace(text, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def tokens(text: Column) -> Column:
    """White-space separated tokens, without empty ones."""
    return F.filter(F.split(text, WHITESPACE + "+"), lambda w: w != "")


def count_where(items: Column, test) -> Column:
    return F.size(F.filter(items, test))


def numeric_tokens(words: Column) -> Column:
    """Number of tokens holding at least one digit."""
    return count_where(words, lambda w: w.rlike(DIGIT))


def capitalised_tokens(words: Column) -> Column:
    """Number of tokens of two or more characters that start in upper case."""
    return count_where(words, lambda w: w.rlike(CAPITALISED))


def lexical_diversity(words: Column) -> Column:
    """Distinct tokens / (tokens + 1)."""
    return F.size(F.array_distinct(words)) / (F.size(words) + F.lit(1))


def keyword_hits(words: Column, vocabulary: Iterable[str]) -> Column:
    """Number of distinct lower-case tokens that occur in the vocabulary."""
    vocab = F.array(*[F.lit(w) for w in vocabulary])
    return F.size(F.array_intersect(words, vocab))


def lower_tokens(text: Column) -> Column:
    return tokens(F.lower(text))


def sentences(text: Column, min_length: int = 20) -> Column:
    """Sentence array of one text.

    A text is cut at white space that follows ``.``, ``!`` or ``?`` and precedes
    an ASCII capital; pieces are stripped, and pieces that are too short or
    consist of digits only are dropped.
    """
    pieces = F.split(text, rf"(?<=[.!?]){WHITESPACE}+(?=[A-Z])")
    return F.filter(
        F.transform(pieces, strip),
        lambda s: (F.length(s) >= min_length) & ~s.rlike(f"^{DIGIT}+$"),
    )
