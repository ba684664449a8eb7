"""Held-out accuracy and the stated cases."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from caseflow.llm import language_id as L
from caseflow.llm import textbuf


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(spark, docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out").collect()
    right = np.mean([r.lang == r.lang_pred for r in got])
    assert len(got) > 150 and right > 0.93, right
    assert all(0 <= r.score <= 1 for r in got)


def test_copies_count_once_in_the_sample(spark):
    rows = [(i, f"copied text {i % 3}", "en") for i in range(300)] + [(1000 + i, f"single text {i}", "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    texts = {r.text[1:] for r in docs.where(~L.held_out("doc_id", 4, 2)).collect()}  # a short text is cut from its second character
    got = L.sample(docs, 40)
    assert len(got) == len(set(got)) == len(texts) and {lang for lang, _ in got} == {"en"}
    assert len(set(L.sample(docs, 10))) == 10


def test_cases(spark):
    en, de = "the cat and the dog of this house with that ", "der Hund und die Katze von diesem Haus mit einem "
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de", "x") for i in range(40)]
    rows += [(100, None, "en", "x"), (101, "", None, "x"), (102, "12 34 !!", None, "x"), (103, en * 4000, None, "x"), (None, de, None, "x"), (104, "z", None, "x"), (103, en * 4000, None, "x"), (105, "ß", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    got = {(r.doc_id): r for r in L.identify(spark, df).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert got[103].lang_pred == "en" and got[None].lang_pred == "de" and not got[None].held_out
    assert got[104].lang_pred in ("en", "de")
    assert L.identify(spark, df.limit(0)).collect() == []
    assert {r.lang_pred for r in L.identify(spark, df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r.lang_pred for r in L.identify(spark, df.where("doc_id < 40 and lang = 'en'")).collect()} == {"en"}


def test_a_text_scores_alike_alone_and_among_others():
    rows = [("en", "the of and to in that"), ("de", "der die und das nicht ein"), ("fr", "le la et les des un"), ("es", "el los de que y una")] * 5
    model = L.train(rows)
    texts = ["the and of", "", "der und", "les des", "x"]
    together = L.predict(model, *textbuf.buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        one = L.predict(model, *textbuf.buffers(pa.array([t])))
        assert one[0][0] == together[0][i] and abs(one[1][0] - together[1][i]) < 1e-6
