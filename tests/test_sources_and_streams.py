import io
import zipfile

from pyspark.sql import functions as F

from veladura.operators import templates
from veladura.plans import ledgers
from veladura.sources import documents

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body: str, header: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        if header:
            z.writestr("word/header1.xml", f"<w:hdr {NS}>{header}</w:hdr>")
    return out.getvalue()


def p(*runs: str) -> str:
    return "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"


def test_files(spark, tmp_path):
    table = "<w:tbl><w:tr><w:tc>" + p("celda") + "</w:tc></w:tr></w:tbl>"
    (tmp_path / "a.docx").write_bytes(docx(table + p("ho", "la") + p(""), p("cabeza")))
    (tmp_path / "b.txt").write_text("texto ñ", encoding="utf-8")
    (tmp_path / "c.pdf").write_bytes(b"no")
    (tmp_path / "d.docx").write_bytes(b"PK\x03\x04 broken")
    (tmp_path / "e.doc").write_bytes(b"x")
    (tmp_path / "f.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "g.exe").write_bytes(b"x")
    rows = {r.path.rsplit("/", 1)[1]: r for r in documents.read(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.docx", "b.txt", "c.pdf", "d.docx", "e.doc", "f.txt"}
    assert rows["a.docx"].text == "hola\n\ncelda\ncabeza"
    assert rows["b.txt"].text == "texto ñ" and rows["b.txt"].extractor == "native_txt"
    assert [rows[k].error for k in ("c.pdf", "d.docx", "e.doc", "f.txt")] == ["PDF_INVALID", "DOCX_INVALID", "DOC_UNSUPPORTED", "TXT_NOT_UTF8"]


def test_runs():
    assert documents.replaced_in_runs(["test@", "example", ".com y"], [("test@example.com", "{{E}}")]) == ["{{E}}", "", " y"]
    assert documents.replaced_in_runs(["aa a", "a"], [("aa", "X")]) == ["X X", ""]
    assert documents.replaced_in_runs([], [("a", "b")]) == []


def test_blocks(spark):
    blocks = spark.createDataFrame([(1, 0, ["DNI 123", "45678"]), (2, 0, ["x"])], "doc_id long, block_no int, runs array<string>")
    values = spark.createDataFrame([(1, "12345678", "{{DNI_1}}")], "doc_id long, value string, token string")
    assert {r.doc_id: r.runs for r in documents.replaced_blocks(blocks, values).collect()} == {1: ["DNI {{DNI_1}}", ""], 2: ["x"]}


def test_reservations(spark):
    log = [(1, 1, 0, "grant", 40), (1, 2, 0, "grant", 40), (1, 3, 7, "reserve", 30), (1, 4, 7, "reserve", 30), (1, 5, 8, "reserve", 30), (1, 6, 7, "release", 0), (1, 7, 8, "reserve", 30), (1, 8, 8, "charge", 0), (1, 9, 8, "release", 0), (1, 10, 0, "adjust", -99), (2, 1, 0, "credit", 5)]
    rows = ledgers.reserved(spark.createDataFrame(log, "user long, seq long, job long, action string, pages long"))
    got = [(r.outcome, r.balance) for r in rows.orderBy("user", "seq").collect()]
    assert got == [("granted", 40), ("ignored", 40), ("reserve", 10), ("repeated", 10), ("blocked", 10), ("released", 40), ("reserve", 10), ("charged", 10), ("ignored", 10), ("adjust", 0), ("credit", 5)]


def test_paragraph_chunks(spark):
    text = "uno dos\n\n" + "palabra " * 40 + "\n\ntres"
    row = spark.createDataFrame([(text,)], "t string").select(templates.paragraphs(F.col("t"), 60).alias("c")).first()
    assert all(len(c) <= 60 for c in row.c)
    assert " ".join(row.c).split() == text.split()
    short = spark.createDataFrame([("x",)], "t string").select(templates.paragraphs(F.col("t")).alias("c")).first()
    assert short.c == ["x"]


def test_streams_over_several_batches(spark, tmp_path):
    """One file a micro-batch: a window that several batches touch comes once, with all of its events."""
    import datetime

    from veladura.streaming import logs

    at = datetime.datetime(2024, 1, 1, 12)
    for i in range(3):
        rows = [(10 * i + j, 7, at + datetime.timedelta(seconds=i * 10 + j), "a", 1.0, False) for j in range(3)]
        spark.createDataFrame(rows, "id long, key long, ts timestamp, kind string, value double, success boolean").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = lambda: spark.readStream.schema("id long, key long, ts timestamp, kind string, value double, success boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = logs.drained(logs.tumbling(stream(), "1 day"), "update", spark, "t", ("start", "kind")).collect()
    assert [(r.n, r.total) for r in got] == [(9, 9.0)]
    bad = logs.drained(logs.failures(stream(), "1 day", "1 day", "10 minutes", 5), "update", spark, "f", ("key", "start", "stop")).collect()
    assert [r.failures for r in bad] == [9]
    calls = logs.drained(logs.limited(stream(), 4, 60), "append", spark, "l").collect()
    assert {r.id for r in calls if r.accepted} == {0, 1, 2, 10} and len(calls) == 9


def test_training_examples_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "DNI 12345678 y S/ 20.50"), (2, "nada")], "doc_id long, text string")
    records = documents.training_records(docs)
    documents.write_jsonl(records, f"{tmp_path}/out")
    back = {r.text: [tuple(e) for e in r.entities] for r in documents.jsonl(spark, f"{tmp_path}/out").collect()}
    assert back == {"DNI 12345678 y S/ 20.50": [(4, 12, "DNI"), (15, 23, "MONTO")], "nada": []}


def test_documents_written_and_read(spark, tmp_path):
    docs = spark.createDataFrame([(1, "docx", "a\nb", ["a", "b"]), (2, "docx", "sin bloques", None), (3, "txt", None, None)], "doc_id long, ext string, text string, blocks array<string>")
    got = {r.path: r.text for r in documents.extracted(documents.write_documents(docs, f"{tmp_path}/o")).collect()}
    assert got == {"1.docx": "a\nb", "2.txt": "sin bloques", "3.txt": ""}
