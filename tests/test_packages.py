"""DOCX files in and out: parts kept byte for byte, tokens across runs, jobs that fail leave nothing."""

import io
import random
import re
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veladura.functions.terms import claimed
from veladura.sources import documents, packages

rng = random.Random(9)
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:w14="urn:w14" mc:Ignorable="w14"'
DOCUMENT = (
    HEAD + f"<w:document {NS}><!-- a > comment --><w:body>"
    '<w:p w14:paraId="1"><w:pPr><w:jc w:val="both"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>Señor Juan Pe</w:t></w:r><w:r><w:t xml:space="preserve">rez &amp; </w:t></w:r>'
    "<w:hyperlink><w:r><w:t>ana@</w:t></w:r><w:r><w:t/></w:r><w:r><w:t>x.pe</w:t></w:r></w:hyperlink><w:r><w:t>.</w:t></w:r></w:p>"
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>DNI 12345678</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>JUAN</w:t></w:r><w:r><w:t> Juan Perez y A &lt; B</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>"
    "<w:p><w:r><w:t>caja Juan </w:t><w:txbxContent><w:p><w:r><w:t>dentro 12345678</w:t></w:r></w:p></w:txbxContent><w:t>Perez</w:t></w:r></w:p>"
    "<w:p><w:r><w:t><![CDATA[Juan <Perez> Juan Perez]]></w:t></w:r></w:p><w:p/></w:body></w:document>"
)
PARTS = {
    "[Content_Types].xml": b"<Types/>",
    "word/document.xml": DOCUMENT.encode(),
    "word/header1.xml": (HEAD + f"<w:hdr {NS}><w:p><w:r><w:t>Juan Perez</w:t></w:r></w:p></w:hdr>").encode(),
    "word/footer2.xml": (HEAD + f"<w:ftr {NS}><w:p><w:r><w:t>pie</w:t></w:r></w:p></w:ftr>").encode(),
    "word/styles.xml": b"<w:styles>Juan Perez</w:styles>",
    "word/media/image1.png": bytes(range(256)),
}
VALUES = [("Juan Perez", "{{PERSONA_1}}", True, "PERSONA"), ("ANA@X.PE", "{{EMAIL_1}}", False, "EMAIL"), ("12345678", "{{DNI_1}}", False, "DNI")]
DICTS = [dict(zip(("value", "token", "soft", "type"), v, strict=True)) for v in VALUES]


def package(parts=PARTS):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def parts_of(data):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {n: z.read(n) for n in z.namelist()}


def test_only_texts_change():
    data, count, error = packages.rewritten_package(package(), DICTS)
    assert (count, error) == (8, None)
    new = parts_of(data)
    assert list(new) == list(PARTS)
    assert {n for n in new if new[n] != PARTS[n]} == {"word/document.xml", "word/header1.xml"}
    want = DOCUMENT
    for old, now in (
        ("Señor Juan Pe</w:t>", "Señor {{PERSONA_1}}</w:t>"), (">rez &amp; <", "> &amp; <"), ("ana@</w:t>", "{{EMAIL_1}}</w:t>"), ("<w:t>x.pe</w:t>", "<w:t></w:t>"),
        ("DNI 12345678", "DNI {{DNI_1}}"), ("<w:t> Juan Perez y A", '<w:t xml:space="preserve"> {{PERSONA_1}} y A'), ("caja Juan </w:t>", "caja {{PERSONA_1}}</w:t>"),
        ("dentro 12345678", "dentro {{DNI_1}}"), ("<w:t>Perez</w:t>", "<w:t></w:t>"), ("<![CDATA[Juan <Perez> Juan Perez]]>", "Juan &lt;Perez&gt; {{PERSONA_1}}"),
    ):
        assert want.count(old) == 1, old
        want = want.replace(old, now)
    assert new["word/document.xml"].decode() == want


def test_nothing_to_replace_keeps_every_byte():
    data, count, error = packages.rewritten_package(package(), [{"value": "nadie", "token": "x", "soft": False, "type": "DNI"}])
    assert (count, error, parts_of(data)) == (0, None, PARTS)


def test_packages_that_are_none():
    assert packages.rewritten_package(b"PK\x03\x04 broken", DICTS) == (None, 0, "DOCX_INVALID")
    assert packages.rewritten_package(package({"a": b"b"}), DICTS) == (None, 0, "DOCX_INVALID")
    assert packages.rewritten_package(package({"word/document.xml": b"<w:p>"}), DICTS) == (None, 0, "DOCX_INVALID")
    assert packages.rewritten_package(package({"word/document.xml": "<a/>".encode("utf-16")}), DICTS) == (None, 0, "DOCX_ENCODING")


def test_spread_is_the_replaced_text():
    for _ in range(500):
        texts = ["".join(rng.choices("ab c", k=rng.randint(0, 4))) for _ in range(rng.randint(1, 6))]
        values = [{"value": "".join(rng.choices("ab ", k=rng.randint(1, 4))), "token": f"<{i}>", "soft": False, "type": "DNI"} for i in range(3)]
        claims = claimed("".join(texts), values)
        out = packages.spread(texts, claims)
        assert "".join(out) == claims.replaced() and len(out) == len(texts)
        for start in claims.starts:  # the token is in the text in which its span begins
            edge = [sum(map(len, texts[: i + 1])) for i in range(len(texts))]
            assert claims.spans[start][1] in out[next(i for i, e in enumerate(edge) if e > start)]


def make_files(folder: Path):
    (folder / "sub").mkdir(parents=True)
    (folder / "a.docx").write_bytes(package())
    (folder / "sub/a.docx").write_bytes(package({"word/document.xml": (HEAD + f"<w:document {NS}><w:body><w:p><w:r><w:t>solo</w:t></w:r></w:p></w:body></w:document>").encode()}))
    for name, data in {"b.txt": "texto ñ".encode(), "c.PDF": b"no", "c2.pdf": b"%PDF-", "d.docx": b"PK\x03\x04 broken", "e.doc": b"x", "f.txt": b"\xff\xfe", "g.exe": b"x", ".h.txt": b"x", "_i.txt": b"x"}.items():
        (folder / name).write_bytes(data)


def test_reading(spark, tmp_path):
    make_files(tmp_path / "in")
    df = packages.read(spark, str(tmp_path / "in"), maxBytes="2000", content="true")
    rows = {r.path[len(str(tmp_path / "in")) + 1 :]: r for r in df.collect()}
    assert set(rows) == {"a.docx", "sub/a.docx", "b.txt", "c.PDF", "c2.pdf", "d.docx", "e.doc", "f.txt"}
    assert df.rdd.getNumPartitions() > 1 and bytes(rows["b.txt"].content) == "texto ñ".encode()
    assert (rows["b.txt"].text, rows["b.txt"].extractor, rows["b.txt"].length, rows["c.PDF"].ext) == ("texto ñ", "native_txt", 8, "pdf")
    errors = {k: r.error for k, r in rows.items() if r.error}
    assert errors == {"c.PDF": "PDF_INVALID", "c2.pdf": "PDF_NO_READER", "d.docx": "DOCX_INVALID", "e.doc": "DOC_UNSUPPORTED", "f.txt": "TXT_NOT_UTF8"}
    assert all((rows[k].text is None) == (k in errors) and (rows[k].extractor is None) == (k in errors) for k in rows)
    old = {r.path.rsplit("/", 2)[-1]: (r.text, r.error) for r in documents.read(spark, str(tmp_path / "in")).collect() if "/sub/" not in r.path and "/_" not in r.path and "/." not in r.path}
    assert old == {k: (r.text, r.error) for k, r in rows.items() if "/" not in k}


def test_variants_are_tried_in_turn(spark, tmp_path):
    (tmp_path / "h.docx").write_bytes(package({"word/document.xml": (HEAD + f"<w:document {NS}><w:body/></w:document>").encode(), "word/header1.xml": PARTS["word/header1.xml"]}))
    (row,) = packages.read(spark, str(tmp_path), variants="primary,whole").collect()
    assert (row.text, row.extractor, row.error) == ("Juan Perez", "native_docx_whole", None)


def test_an_empty_folder(spark, tmp_path):
    assert packages.read(spark, str(tmp_path)).collect() == []


def test_files_out_and_in_again(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{i}.txt", f"texto {i}".encode()) for i in range(20)] + [("nada.txt", None)], "name string, content binary").repartition(4)
    packages.write(rows, str(tmp_path / "out"))
    got = {r.path.rsplit("/", 1)[1]: r.text for r in packages.read(spark, str(tmp_path / "out")).collect()}
    assert got == {f"f{i}.txt": f"texto {i}" for i in range(20)}
    packages.write(rows.limit(0), str(tmp_path / "out"))
    assert packages.read(spark, str(tmp_path / "out")).count() == 20
    packages.write(rows.where("name = 'f1.txt'"), str(tmp_path / "out"), "overwrite")
    assert [r.text for r in packages.read(spark, str(tmp_path / "out")).collect()] == ["texto 1"]
    assert not [p for p in (tmp_path / "out").rglob("*") if p.name.startswith("_")]


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    packages.write(spark.createDataFrame([("alt.txt", b"alt")], "name string, content binary"), str(out))
    rows = spark.createDataFrame([(f"f{i}.txt", b"x") for i in range(40)], "name string, content binary").repartition(4)
    broken = rows.withColumn("content", F.when(F.col("name") == "f33.txt", F.raise_error(F.lit("halt")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="halt"):
        packages.write(broken, str(out))
    with pytest.raises(Exception, match="not a name"):
        packages.write(rows.withColumn("name", F.lit("same.txt")).coalesce(1), str(out))
    assert [p.name for p in out.rglob("*") if p.is_file()] == ["alt.txt"]


def test_anonymized_files(spark, tmp_path):
    text = "El demandante Juan Perez Soto identificado con DNI N° 12345678, correo electronico: juan@mail.gob.pe. "
    cut = [text[i : i + 7] for i in range(0, len(text), 7)]
    body = "".join(f'<w:r><w:t xml:space="preserve">{c}</w:t></w:r>' for c in cut)
    (tmp_path / "in/x").mkdir(parents=True)
    document = (HEAD + f"<w:document {NS}><w:body><w:p>{body}</w:p></w:body></w:document>").encode()
    (tmp_path / "in/x/a.docx").write_bytes(package({**PARTS, "word/document.xml": document}))
    (tmp_path / "in/bad.docx").write_bytes(b"PK")
    got = {r.name: (r.replaced > 0, r.error, r.is_safe) for r in packages.anonymized(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()}
    assert got == {"x_a.docx": (True, None, True), "bad.docx": (False, "DOCX_INVALID", False)}
    (row,) = packages.read(spark, str(tmp_path / "out"), content="true").collect()
    assert "12345678" not in row.text and "juan@mail" not in row.text and "{{DNI_100}}" in row.text and "{{EMAIL_1}}" in row.text
    new = parts_of(bytes(row.content))
    assert new["word/media/image1.png"] == PARTS["word/media/image1.png"] and new["word/styles.xml"] == PARTS["word/styles.xml"]
    assert re.sub(r"<w:t[^>]*>[^<]*</w:t>", "", new["word/document.xml"].decode()) == re.sub(r"<w:t[^>]*>[^<]*</w:t>", "", document.decode())
