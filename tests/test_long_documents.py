"""Documents with thousands of finds: the same answers as plain versions, in time that follows the text."""

import random
import time

from pyspark.sql import functions as F

from veladura.operators import audit, tokens
from veladura.operators.merge import merged

rng = random.Random(21)
KIND = "array<struct<type:string,value:string,start:int,stop:int,seq:int>>"


def plain_merge(every):
    out = []
    for e in sorted(every, key=lambda e: (e[2], e[2] - e[3], e[4])):
        if not out or out[-1][3] <= e[2]:
            out.append(e)
        elif e[3] - e[2] > out[-1][3] - out[-1][2]:
            out[-1] = e
    return out


def test_merge_of_few_and_many(spark):
    rows = []
    for i, (n, width, reach) in enumerate([(0, 9, 50), (1, 9, 50), (40, 30, 200), (256, 9, 2000), (257, 9, 2000), (1500, 9, 9000), (1500, 60, 4000), (600, 3, 60)]):
        own = []
        for seq in range(n):
            start = rng.randrange(reach)
            own.append(("T", "v", start, start + rng.randint(1, width), seq))
        rows.append((i, own))
    df = spark.createDataFrame(rows, f"i int, e {KIND}")
    got = {r.i: [tuple(x) for x in r.m] for r in df.select("i", merged(F.col("e"), KIND).alias("m")).collect()}
    assert got == {i: plain_merge(own) for i, own in rows}


def test_replacement_by_place_over_blocks(spark):
    rows = []
    for i, n in enumerate((0, 1, 1023, 1024, 1025, 5000)):
        text = "".join(rng.choices("añ😀b ", k=n))
        edges = sorted(rng.sample(range(n + 1), min(n + 1, 40)))
        spots = [(a, b, f"<{a}>") for a, b in zip(edges[::2], edges[1::2], strict=False)]
        rows.append((i, text, spots))
    df = spark.createDataFrame(rows, "i int, text string, spots array<struct<start:int,stop:int,token:string>>")
    got = {r.i: r.out for r in df.select("i", tokens.replaced_at(F.col("text"), F.col("spots")).alias("out")).collect()}
    for i, text, spots in rows:
        want, at = "", 0
        for a, b, t in spots:
            want, at = want + text[at:a] + t, b
        assert got[i] == want + text[at:]


def test_audit_of_a_long_text(spark):
    """The order of tokens: counted from the end, one for each value, on from what the text holds."""
    pairs = [f"correo u{i % 1500}@mail.pe DNI {10000000 + i} y" for i in range(2000)]
    docs = spark.createDataFrame([(1, " ".join(pairs) + " fin del documento tan largo {{DNI_7}}")], "doc_id long, text string")
    audit.fixed(docs.limit(0)).collect()
    began = time.time()
    row = audit.fixed(docs).first()
    assert time.time() - began < 30
    assert (row.fixes, row.remaining, row.is_safe) == (4000, 0, True)
    mails, want = {}, []
    for i in reversed(range(2000)):
        mail = mails.setdefault(i % 1500, 100 + len(mails))
        want.append(f"correo {{{{EMAIL_{mail}}}}} DNI {{{{DNI_{8 + 1999 - i}}}}} y")
    assert row.fixed_text == " ".join(reversed(want)) + " fin del documento tan largo {{DNI_7}}"
