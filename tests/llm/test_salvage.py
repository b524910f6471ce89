"""The salvage reader on damaged archives: each damage costs no more than what it hits."""

import glob
import gzip
import random
import zlib

import pytest

from veladura.llm import warc


def record(body: bytes) -> bytes:
    return b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)


def blocks(data):
    return [x.block for x in warc.salvage(bytes(data)) if isinstance(x, warc.Record)]


def noise(n):
    return random.Random(n).randbytes(n).hex().encode()


def test_damaged_start_does_not_hide_later_members():
    parts = [record(noise(n)) for n in (200, 201, 202)]
    members = [gzip.compress(x) for x in parts]
    data = bytearray(b"".join(members))
    data[:80] = b"?" * 80
    assert blocks(data) == [noise(201), noise(202)]
    (gap,) = [x for x in warc.salvage(bytes(data)) if isinstance(x, warc.Gap)]
    assert (gap.start, gap.stop) == (0, len(members[0]))


def test_plain_and_members_mixed():
    data = bytearray(record(b"one") + gzip.compress(record(b"two")) + record(b"three") + gzip.compress(record(b"four")))
    assert blocks(data) == [b"one", b"two", b"three", b"four"]
    data[:4] = b"????"
    assert blocks(data) == [b"two", b"three", b"four"]


def test_all_output_before_a_fault_is_kept():
    # a small member with a bad trailer only
    data = bytearray(gzip.compress(record(b"small")) + gzip.compress(record(b"next")))
    data[len(gzip.compress(record(b"small"))) - 6] ^= 255
    assert blocks(data) == [b"small", b"next"]
    # records in front of the damage, though in the same read
    rows = [record(noise(300 + i)) for i in range(5)]
    whole = gzip.compress(b"".join(rows))
    inflate, out, cut = zlib.decompressobj(31), b"", 0
    while len(out) < sum(map(len, rows[:3])):
        out += inflate.decompress(whole[cut : cut + 1])
        cut += 1
    assert blocks(whole[:cut] + b"\xff" * (len(whole) - cut) + gzip.compress(record(b"next")))[:3] == [noise(300 + i) for i in range(3)]
    assert blocks(whole[:cut] + b"\xff" * (len(whole) - cut) + gzip.compress(record(b"next")))[-1] == b"next"


def test_stored_blocks_do_not_give_records_twice():
    data = bytearray(gzip.compress(record(b"stored"), compresslevel=0) + gzip.compress(record(b"next")))
    data[len(gzip.compress(record(b"stored"), compresslevel=0)) - 6] ^= 255
    assert blocks(data) == [b"stored", b"next"]


def test_a_gzip_payload_of_a_damaged_record_stays_in_the_gap():
    data = bytearray(record(gzip.compress(b"no archive")) + record(b"next"))
    data[:4] = b"????"
    got = [*warc.salvage(bytes(data))]
    assert [type(x) for x in got] == [warc.Gap, warc.Record] and got[1].block == b"next"


@pytest.mark.parametrize("per_file", [3, 2000])
def test_one_bad_byte_costs_one_record(spark, tmp_path, per_file):
    pages = spark.createDataFrame([(i, f"http://x/{i}", noise(100 + i).decode()) for i in range(10)], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, f"{tmp_path}/w", per_file)
    for file in glob.glob(f"{tmp_path}/w/part-*"):
        with open(file, "rb") as f:
            data = bytearray(f.read())
        if not data:
            continue
        whole = len(blocks(data))
        data[40] ^= 255
        assert len(blocks(data)) >= whole - 1
    assert warc.read(spark, f"{tmp_path}/w").where("gap is null").count() == 10
