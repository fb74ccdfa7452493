"""Text normalization: tokens, facet keys and codes.

Spark has neither NFKC nor full case folding. Text of PLAIN characters is folded by built-in functions, which is exact for
them (a test holds each character against unicodedata); other text, and it alone, is folded by an Arrow function. So each
row is exact whatever its script, and rows of the common European alphabets stay in the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges of characters that lower case (and ss for the sharp s) folds as NFKC and case folding do, next to any other of them.
PLAIN = r"\x00-\x7F\xA1-\xA7\xA9\xAB\xAC\xAE\xB0\xB1\xB6\xB7\xBB\xBF-\u012F\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0400-\u045F\u2013\u2014\u2018-\u201E\u2022\u20AC"
#: A token's borders.
_BORDER = (r"(?<![\p{L}\p{M}\p{N}])", r"(?![\p{L}\p{M}\p{N}])")
_RUNS = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


def split_tokens(text: str) -> list[str]:
    """The tokens of one text: maximal runs of letters, marks and numbers once it is folded."""
    return _RUNS.findall(fold(text))


def facet_text(text: str) -> str:
    return " ".join(fold(text).split())


@F.pandas_udf(T.ArrayType(T.StringType()))
def exact_tokens(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else split_tokens(t))


@F.pandas_udf(T.StringType())
def exact_facet_key(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else facet_text(v))


@F.pandas_udf(T.ArrayType(T.StringType()))
def exact_facet_keys(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else [None if x is None else facet_text(x) for x in v])


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _odd(c: Column) -> Column:
    # text of as many bytes as characters is ASCII, and plain without a look at each character
    return (F.octet_length(c) != F.length(c)) & c.rlike(f"[^{PLAIN}]")


def _lower(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def _plain_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(_lower(c), r"(?U)\s+", " "))


def lexical_tokens(text: str | Column) -> Column:
    """Maximal runs of letters, marks and numbers of the folded text; null for null."""
    c = _column(text)
    return F.when(~_odd(c), F.regexp_extract_all(_lower(c), F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1))).otherwise(exact_tokens(F.when(_odd(c), c)))


def lexical_matches(text: str | Column, terms: list[str]) -> Column:
    """The ones of terms (folded tokens) that a text has, in their order; null for null.

    A term is looked for in the text itself, up to its first place, so no list of tokens is built for plain rows.
    """
    c = _column(text)
    own = lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)) & low.rlike(f"{_BORDER[0]}{t}{_BORDER[1]}"), t) for t in terms]))
    # a lambda's variable is computed once, however often it is used
    found = F.transform(F.array(_lower(c)), own)[0]
    return F.when(~_odd(c), found).otherwise(F.array_intersect(F.array(*map(F.lit, terms)), exact_tokens(F.when(_odd(c), c))))


def holds_phrase(text: str | Column, terms: list[str]) -> Column:
    """Do the terms stand one after another? Tokens are apart by anything but letters, marks and numbers."""
    c = _column(text)
    pattern = _BORDER[0] + r"[^\p{L}\p{M}\p{N}]+".join(terms) + _BORDER[1]

    def run(low: Column) -> Column:
        test = low.rlike(pattern)
        for t in dict.fromkeys(terms):  # plain containment first: it is far cheaper
            test = F.contains(low, F.lit(t)) & test
        return test

    inside = F.exists(F.array(_lower(c)), run)
    exact = F.concat(F.lit(" "), F.array_join(exact_tokens(F.when(_odd(c), c)), " "), F.lit(" "))
    return F.when(~_odd(c), inside).otherwise(F.contains(exact, F.lit(f" {' '.join(terms)} ")))


def facet_key(value: str | Column) -> Column:
    """Folded text with single spaces and none at the ends; punctuation stays."""
    c = _column(value)
    return F.when(~_odd(c), _plain_key(c)).otherwise(exact_facet_key(F.when(_odd(c), c)))


def facet_keys(values: str | Column) -> Column:
    """facet_key of each element of an array."""
    c = _column(values)
    odd = F.exists(c, lambda v: _odd(F.coalesce(v, F.lit(""))))
    return F.when(~odd, F.transform(c, _plain_key)).otherwise(exact_facet_keys(F.when(odd, c)))


class CodeRules:
    """How codes of one profile are compared: case, delimiters that count, and the prefix rule."""

    def __init__(self, delimiters: tuple[str, ...] = (".",), ignore_case: bool = True, fold_punctuation: bool = True, fold_spaces: bool = True):
        self.delimiters = tuple(sorted(delimiters, key=lambda d: (-len(d), d)))
        self.ignore_case, self.fold_punctuation, self.fold_spaces = ignore_case, fold_punctuation, fold_spaces

    def normalize(self, code: str) -> str:
        """NFKC, case, spaces and punctuation other than delimiters as the rules say; longer delimiters are seen first."""
        text = unicodedata.normalize("NFKC", code)
        if self.ignore_case:
            text = text.casefold()
        if self.fold_spaces:
            text = "".join(text.split())
        if not self.fold_punctuation:
            return text
        marks = "|".join(map(re.escape, self.delimiters))
        pieces = re.split(f"({marks})", text) if marks else [text]
        return "".join(p if p in self.delimiters else "".join(c for c in p if unicodedata.category(c)[0] != "P") for p in pieces)

    def normalize_prefix(self, code: str) -> str:
        """As normalize, without delimiters at the end."""
        text = self.normalize(code)
        while any(text.endswith(d) for d in self.delimiters):
            text = next(text[: -len(d)] for d in self.delimiters if text.endswith(d))
        return text

    def column(self, code: str | Column) -> Column:
        """normalize as an expression; null for null."""
        c = _column(code)
        plain = _lower(c) if self.ignore_case else c
        plain = F.regexp_replace(plain, r"(?U)\s+", "") if self.fold_spaces else plain
        if self.fold_punctuation:
            kept = "|".join(map(re.escape, self.delimiters))
            plain = F.regexp_replace(plain, rf"(?:({kept})|\p{{P}})", "$1") if kept else F.regexp_replace(plain, r"\p{P}", "")
        return F.when(~_odd(c), plain).otherwise(self.udf()(F.when(_odd(c), c)))

    def starts(self, code: Column, prefix: str) -> Column:
        """Does the prefix end at a border of the code? B4.1 is a prefix of B4.1.2 and not of B4.10."""
        out = code == prefix
        for d in self.delimiters:
            out = out | code.startswith(prefix + d)
        return out

    def udf(self):
        rules = self

        @F.pandas_udf(T.StringType())
        def run(codes: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in codes:
                yield part.map(lambda v: None if v is None else rules.normalize(v))

        return run
