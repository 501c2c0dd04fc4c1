"""Functions that columns cannot express, on Arrow batches."""

from __future__ import annotations

import difflib
import math
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spanish vowels, and consonants that stay together.
VOWELS = "aeiouáéíóúüAEIOUÁÉÍÓÚÜ"
TOGETHER = ("pr", "br", "tr", "dr", "cr", "gr", "fr", "pl", "bl", "cl", "gl", "fl", "ll", "rr", "ch")

#: A syllable starts at the consonant or pair before a vowel, once a vowel has gone by.
_CUT = re.compile(rf"(?<=[{VOWELS}])([^{VOWELS}]*?)((?:{'|'.join(TOGETHER)}|[^{VOWELS}])(?=[{VOWELS}]))", re.IGNORECASE)


def syllables(word: str) -> list[str]:
    """Parts of a word; together they are the word without outer space. A word with
    at most one vowel group stays as it is, spaces included."""
    core = word.strip()
    cut = _CUT.sub("\\1\0\\2", core)
    return cut.split("\0") if "\0" in cut else [word]


def similarity(a: str, b: str) -> float:
    """Ratcliff and Obershelp's ratio of matching characters."""
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


@F.pandas_udf(T.ArrayType(T.StringType()))
def syllables_of(x: pd.Series) -> pd.Series:
    return x.map(lambda w: None if w is None else syllables(w))


@F.pandas_udf(T.DoubleType())
def similarity_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or q is None else similarity(p, q) for p, q in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def midi_of(hz: pd.Series) -> pd.Series:
    """timing.midi_of() by C's logarithm, as SQL engines have it; null without pitch. Spark's is a
    quotient of two logarithms, which in three of ten pitches is the next number up or down."""
    return pd.Series([69 + 12 * math.log2(x / 440.0) if x > 0 else None for x in hz], dtype="float64")


@F.pandas_udf(T.StringType())
def decoded(x: pd.Series) -> pd.Series:
    """Bytes of a chart file: UTF-8 without its mark, else the Windows code page,
    else Latin-1."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        for code in ("utf-8-sig", "cp1252"):
            try:
                return b.decode(code)
            except UnicodeDecodeError:
                continue
        return b.decode("latin-1")

    return x.map(one)
