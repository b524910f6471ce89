"""Empty tables, and tables whose extra columns bear the names of results."""

import public_tokenizers
from pyspark.sql import functions as F

from veladura.llm import bpe, brown_lm, chat, packing, quality, secrets, warc

DOCS = "doc_id long, text string, lang string, score string, n_words string, spans string, node string"


def test_empty_documents(spark):
    docs = spark.createDataFrame([], DOCS)
    assert brown_lm.scored(docs, F.lit(True), brown_lm.Params(head=8, signatures=4, lookup=8, classes=4))[0].collect() == []
    assert packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json")).collect() == []
    assert bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json")).collect() == []
    assert quality.judged(docs, quality.fit(docs)).collect() == []
    assert secrets.found(docs).collect() == [] and secrets.redacted(docs).collect() == []


def test_training_on_nothing(spark):
    docs = spark.createDataFrame([(1, "a b", None, "x", "x", "x", "x"), (2, None, None, "x", "x", "x", "x")], DOCS)
    rows = brown_lm.scored(docs, F.lit(False), brown_lm.Params(head=8, signatures=4, lookup=8, classes=4))[0].collect()
    assert {r.doc_id: (r.n_tokens, r.n_known) for r in rows} == {1: (3, 0), 2: (1, 0)}


def test_empty_logs_and_pages(spark, tmp_path):
    log = spark.createDataFrame([], "conv long, seq long, msg string, kind string, role string, text string")
    assert chat.read_back(chat.pieces(log)).collect() == [] and chat.formatted(log).collect() == []
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/w")
    assert warc.read(spark, f"{tmp_path}/w").collect() == []


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "secret=abcdefg", "en", "old", "old", "old", "old")], DOCS)
    (row,) = quality.judged(docs, quality.fit(docs)).collect()
    assert (row.n_words, row.score) == (1, "old")
    (row,) = secrets.redacted(docs).collect()
    assert (row.text, row.spans) == ("[ASSIGN]", "old")
