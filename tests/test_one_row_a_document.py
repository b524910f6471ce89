"""Queries that need one document at a time: no join and no shuffle of texts, one row an order also where keys repeat."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from veladura.functions import fixed as X
from veladura.operators import templates, tokens
from veladura.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Orders of which every third comes twice, with another customer."""
    at = tmp_path_factory.mktemp("repeated")
    rows = spark.read.parquet(f"{SF}/orders.parquet").limit(60)
    rows.unionByName(rows.where("o_orderkey % 3 = 0").withColumn("o_custkey", F.col("o_custkey") + 1)).write.parquet(f"{at}/orders.parquet")
    return str(at)


def test_pre_redaction_takes_one_pass(spark):
    docs = spark.createDataFrame([(1, "a@b.pe, DNI 12345678, paga S/ 87654321 y 20123456789, c@d.pe"), (2, None), (3, "nada")], "doc_id long, text string")
    rows = templates.pre_redacted(docs)
    assert plan(rows).count("ArrowEvalPython") == 1
    got = {r.doc_id: (r.clean, r.marks) for r in rows.collect()}
    marks = {"[EMAIL_PRE_1]": "a@b.pe", "[EMAIL_PRE_2]": "c@d.pe", "[RUC_PRE_1]": "20123456789", "[DNI_PRE_1]": "12345678"}
    assert got == {1: ("[EMAIL_PRE_1], DNI [DNI_PRE_1], paga S/ 87654321 y [RUC_PRE_1], [EMAIL_PRE_2]", marks), 2: (None, {}), 3: ("nada", {})}


def test_pre_redaction_finds_what_its_patterns_find():
    parts = ["a", "Ab", "ABC", "xſK", "_", "ñ", "@", ".", "-", "+", "%", " ", "\n", "9", "51", "+51", "10", "20", "123", "456789", "987654321", "12345678901", "٣٤٥", "mail.pe", "S/", "x.y@z.pe", "[TEL_PRE_1]"]
    rng = random.Random(7)
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        for (name, fast), (_, plain) in zip(templates.PRE_KINDS, [*X.PRE_REDACT, ("DNI_PRE", X.PRE_REDACT_DNI)], strict=True):
            want = [m.span() for m in re.finditer(plain, text, re.I if name in ("EMAIL_PRE", "PLACA_PRE") else 0)]
            assert list(templates.pre_places(name, fast, text)) == want, (name, text)


def test_pre_redaction_is_undone_once_an_order(spark, repeated):
    got = QUERIES["pre_redact_restored"](spark, repeated)
    assert "Join" not in plan(got)
    assert [r.same for r in got.collect()] == [True] * spark.read.parquet(f"{repeated}/orders.parquet").count()


@pytest.mark.parametrize("order", ["last", "longest", "listed"])
def test_numbers_within_a_document_are_those_of_rows(spark, order):
    rng = random.Random(3)
    values = ["ab", " AB", "Ab  ", "c", "straße", "STRASSE", "d e", None]
    rows = [(d, rng.choice(["DNI", "EMAIL", "RUC"]), rng.choice(values), at * 10, at * 10 + 5, seq) for d in range(80) for seq, at in enumerate(rng.sample(range(40), rng.randint(1, 12)))]
    df = spark.createDataFrame(rows, "doc_id long, type string, value string, start int, stop int, seq int")
    want = tokens.numbered(df, order).select("doc_id", "seq", "token").collect()
    docs = df.groupBy("doc_id").agg(F.collect_list(F.struct("type", "value", "start", "stop", "seq")).alias("found"))
    got = docs.select("doc_id", F.inline(tokens.numbered_in(F.col("found"), order))).select("doc_id", "seq", "token").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("name", ["tokens_listed", "tokens_last", "tokens_longest", "mapping_csv_rows", "report_json", "mapping_json"])
def test_documents_of_one_row_are_numbered_where_they_are(spark, repeated, name):
    """The one shuffle before the texts is that of the keys; what comes in several rows is still numbered together."""
    whole = QUERIES[name](spark, SF)
    assert len(re.findall(r"Window \[dense_rank", plan(whole))) <= 2 and "numbered" not in whole.columns
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{repeated}/orders.parquet/*.parquet'")
    got = QUERIES[name](spark, repeated)
    cols = ", ".join(f'"{c}"' for c in got.columns)
    want = db.execute(f"SELECT {cols} FROM ({ORACLE[name]})").fetchall()
    once = {r.o_orderkey for r in spark.read.parquet(f"{repeated}/orders.parquet").groupBy("o_orderkey").count().where("count = 1").collect()}
    have = [tuple(r) for r in got.collect()]
    assert sorted(r for r in have if r[0] in once) == sorted(r for r in want if r[0] in once)
    assert {r[0] for r in have} == {r[0] for r in want} and len(have) == len(want)
