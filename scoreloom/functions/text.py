"""Text normalisation and error rates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .numerics import dbl, let


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def _word_codes(a: Column, b: Column) -> Column:
    """Every distinct word of a pair as one character, so that the built-in edit distance counts words.

    A word's character is its place among the pair's distinct words, kept in a map.
    """
    words = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))
    # code points: below the surrogates as they are, above them past the gap
    point = lambda i: F.when(i < 0xD800, i).otherwise(i + 0x800)
    char = lambda i: F.decode(F.unhex(F.lpad(F.hex(point(i)), 8, "0")), "UTF-32")
    code = lambda t, chars: F.array_join(F.transform(words(t), lambda w: F.element_at(chars, w)), "")
    table = lambda both: F.map_from_arrays(both, F.transform(both, lambda _, i: char(i + 1)))
    chars = lambda both: let(table(both), lambda m: F.struct(code(a, m).alias("a"), code(b, m).alias("b")))
    return let(F.array_distinct(F.concat(words(a), words(b))), chars)


def normalised(text: Column) -> Column:
    """NFC, lower case, runs of white space as one blank, ends trimmed.

    The composition step has no built-in and runs on Arrow batches, for texts
    with characters beyond ASCII only; the rest stays in the JVM.
    """
    composed = F.when(text.rlike(r"[^\x00-\x7F]"), _nfc(text)).otherwise(text)
    return F.trim(F.regexp_replace(F.lower(composed), r"(?U)\s+", " "))


def _rate(edits: Column, reference: Column, hypothesis: Column, length: Column) -> Column:
    return (F.when((reference == "") & (hypothesis == ""), dbl(0)).when((reference == "") | (hypothesis == ""), dbl(1))
            .otherwise(edits / length))


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character edits over reference length, on normalised texts."""
    return _rate(F.levenshtein(reference, hypothesis), reference, hypothesis, F.length(reference))


def wer(reference: Column, hypothesis: Column) -> Column:
    """Word edits over reference words, on normalised texts."""
    codes = _word_codes(reference, hypothesis)
    edits = let(codes, lambda c: F.levenshtein(c["a"], c["b"]))
    return _rate(edits, reference, hypothesis, F.size(F.split(reference, " ")))


def word_count(text: Column) -> Column:
    trimmed = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))
