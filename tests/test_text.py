import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscope.functions import text as X
from corpuscope.operators.corpus import corpus_documents


def words(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(X.sequences(F.col("t")).alias("s")).first()["s"]


def test_sentences_and_words(spark):
    assert words(spark, "Uno due. Tre quattro") == [["uno", "due"], ["tre", "quattro"]]
    assert words(spark, "uno. due") == [["uno", "due"]]
    assert words(spark, "l'eau c'est") == [["eau", "est"]]
    assert words(spark, "42 ???\n\nab") == [["ab"]]
    assert words(spark, "") == []


def test_nfc(spark):
    texts = ["café noir", "plain", None, "Å ngstrom", "é́"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["t"] for r in X.nfc(df, "t").collect()}
    assert got == {i: t and unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.characters(blacklist_categories=("Cs",)), min_size=1, max_size=40))
def test_what_the_filter_calls_normal_is_normal(chars):
    import re

    text = "".join(chars)
    body = X.MAYBE_NOT_NFC.replace(r"\p{M}", "".join(c for c in text if unicodedata.category(c).startswith("M")))
    if not re.search(body.replace(r"[^\u0000-￿]", "[\U00010000-\U0010FFFF]"), text):
        assert unicodedata.normalize("NFC", text) == text


def test_null_text_has_no_sequences(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "Aa bb.", None)], "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r["seqs"] for r in corpus_documents(docs).collect()}
    assert rows == {1: [], 2: [["aa", "bb"]]}


def test_klingon(spark):
    df = spark.createDataFrame([("tlhIngan Hol Dajatlh’a'?",)], "t string")
    assert df.select(X.klingon_words(F.col("t")).alias("w")).first()["w"] == ["tlhIngan", "Hol", "Dajatlh'a'"]
