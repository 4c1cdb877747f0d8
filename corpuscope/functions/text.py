"""Tokenization as column expressions: sentences, words, n-grams, characters."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Capitals before which a sentence ends (fixed values).
CAPITALS = "A-ZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
#: Vowels of the registered feature set (fixed values).
VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿœаеёиоуыэюяіїєўآاويىة"
SENTENCE_END = rf"(?<=[.!?])[\s\x1c-\x1f\x85\p{{Z}}]+(?=[{CAPITALS}])|[\n\r]+"
LEAST_WORD = 2
WORD = rf"[\p{{L}}\p{{Nl}}\p{{No}}]{{{LEAST_WORD},}}"
GRAM_SEPARATOR = " | "
#: Characters that may stand in a text which isn't in normal form C.
MAYBE_NOT_NFC = r"[\p{M}\u0340-\u0387\u1100-\u11FF\u1F00-\u1FFF\u2000\u2001\u2126\u212A\u212B\u2329\u232A\u2ADC\uF900-\uFB4F]|[^\u0000-\uFFFF]"


def nfc(df: DataFrame, column: str) -> DataFrame:
    """Normal form C. Only rows with a character that may change leave the JVM."""
    # Latin letters up to here compose with nothing, which most texts show at a glance.
    maybe = F.coalesce(F.col(column).rlike(r"[^\u0000-\u02FF]") & F.col(column).rlike(MAYBE_NOT_NFC), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            done = pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), done)

    return df.filter(~maybe).union(df.filter(maybe).mapInArrow(run, df.schema))


def sentences(text: Column) -> Column:
    """Sentences of a text, trimmed, without blank ones."""
    blank = r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$"
    return F.filter(F.transform(F.split(text, SENTENCE_END, -1), lambda s: F.regexp_replace(s, blank, "")), lambda s: s != "")


def words(sentence: Column) -> Column:
    """Letter runs of two code points or more, lower-cased."""
    runs = F.regexp_extract_all(sentence, F.lit(WORD), F.lit(0))
    return F.transform(runs, lambda w: F.lower(w))


def sequences(text: Column) -> Column:
    """Words of each sentence, without empty sentences. Blanks at a sentence's ends hold no words, so they needn't go first."""
    return F.filter(F.transform(F.split(text, SENTENCE_END, -1), words), lambda s: F.size(s) > 0)


def klingon_words(sentence: Column) -> Column:
    """Latin transcription with apostrophes; case matters."""
    plain = F.translate(sentence, "’‘ʼ", "'''")
    return F.regexp_extract_all(plain, F.lit("[A-Za-z']*[A-Za-z][A-Za-z']*"), F.lit(0))


def grams(tokens: Column, n: int) -> Column:
    """Word n-grams of one sequence as joined keys."""
    at = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    return F.when(F.size(tokens) >= n, F.transform(at, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), GRAM_SEPARATOR))).otherwise(F.array().cast("array<string>"))


def char_grams(token: Column, n: int) -> Column:
    """Character n-grams of ^token$."""
    framed = F.concat(F.lit("^"), token, F.lit("$"))
    at = F.sequence(F.lit(1), F.length(framed) - (n - 1))
    return F.when(F.length(framed) >= n, F.transform(at, lambda i: F.substring(framed, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def inner_pairs(token: Column) -> Column:
    """Neighbouring characters within a token."""
    at = F.sequence(F.lit(1), F.length(token) - 1)
    return F.when(F.length(token) >= 2, F.transform(at, lambda i: F.substring(token, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
