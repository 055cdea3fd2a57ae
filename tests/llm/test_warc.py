import gzip
import hashlib
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from cloneloom.llm import queries, warc


def record(n, block=b"<p>hello</p>", digest=None):
    digest = digest or hashlib.sha1(block).hexdigest()
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nWARC-Block-Digest: sha1:{digest}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def read(data):
    out = list(warc.salvage(data))
    assert sum(x[2] for x in out if x[0] == "gap") <= len(data)
    return [(x[0], x[3]["warc-record-id"] if x[0] == "record" else (x[1], x[2])) for x in out]


def ids(data):
    return [int(x[1][10:-1]) for x in read(data) if x[0] == "record"]


def gaps(data):
    return [x[1] for x in read(data) if x[0] == "gap"]


def test_whole_archive():
    data = b"".join(map(record, range(5)))
    assert ids(data) == [0, 1, 2, 3, 4] and gaps(data) == []


@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress])
def test_records_after_damage_are_recovered(pack):
    parts = [pack(record(i, bytes([65 + i]) * 200)) for i in range(5)]
    bad = bytearray(parts[2])
    bad[len(bad) // 2] ^= 255
    data = b"".join([*parts[:2], bytes(bad), *parts[3:]])
    assert ids(data) == [0, 1, 3, 4]
    assert gaps(data) == [(len(parts[0]) + len(parts[1]), len(parts[2]))]


def test_junk_truncation_and_false_starts():
    inner = record(9, b"x" * 30)
    a, b = record(1), record(2, b"text with WARC/1.1\r\n inside " + inner)
    assert ids(a + b"junk WARC/1.1\r\nno header end" + b) == [1, 2]
    assert gaps(b"lost" + a) == [(0, 4)]
    assert ids(a + b[: len(b) - 4]) == [1, 9] and ids(a + record(3, digest="0" * 40) + record(4)) == [1, 4]
    cut = gzip.compress(record(7))[:-6]
    assert ids(gzip.compress(a) + cut + gzip.compress(record(8))) == [1, 8]
    assert read(b"") == []


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, tmp_path, compression):
    big = "é" * 600
    rows = [(1, "http://a\r\nX: y", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", big + "!\r\n\r\nWARC/1.1\r\n"), (7, "u", big), (None, "u", big)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    path = str(tmp_path / compression)
    warc.write_warc(pages, path, compression)
    got = warc.read_warc(spark, path, payloads=True).collect()
    assert len(got) == len(rows) and {r.kind for r in got} == {"record"}
    by = {(r.page_id, r.payload_bytes): r for r in got}
    assert by[1, 1200].record_type == "revisit" and by[1, 1200].refers_to == 7 and by[2, 1200].refers_to == 7
    assert by[7, 1200].record_type == by[None, 1200].record_type == by[3, 5].record_type == by[4, 5].record_type == "response"
    assert by[1, 1200].payload_digest == hashlib.sha1(big.encode()).hexdigest() and by[1, 1200].url == "http://aX: y"
    assert by[5, 0].payload == b"" and bytes(by[7, 1200].payload).decode() == big


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 0


def test_written_archives_survive_damage_in_one_record(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(pages, str(tmp_path / "w"), "gzip")
    (part,) = (tmp_path / "w").glob("part-*")
    data = part.read_bytes()
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 40
    whole = list(warc.salvage(data))
    assert [x[0] for x in whole] == ["record"] * 40 and sum(x[2] for x in whole) == len(data)
    lost, at, n = whole[20][3]["warc-record-id"], whole[20][1], whole[20][2]
    bad = bytearray(data)
    bad[at + n // 2] ^= 255
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "crawl.warc.gz").write_bytes(bad)
    got = warc.read_warc(spark, str(tmp_path / "d")).collect()
    assert [(r.at, r.n_bytes) for r in got if r.kind == "gap"] == [(at, n)]
    assert {r.page_id for r in got if r.kind == "record"} == set(range(40)) - {int(lost[10:-1])}
    assert warc.read_warc(spark, str(tmp_path / "d"), names="part-*").count() == 0


def test_failed_members_keep_what_did_unpack():
    draw = __import__("random").Random(3)
    parts = [record(i, bytes(draw.randrange(256) for _ in range(3000))) for i in range(9)]
    packed = gzip.compress(b"".join(parts))
    bad = bytearray(packed)
    bad[-6] ^= 255  # its checksum
    data = gzip.compress(record(20)) + bytes(bad) + gzip.compress(record(21))
    assert ids(data) == [20, *range(8), 21]
    cut = packed[: len(packed) * 6 // 10]
    data = gzip.compress(record(20)) + cut + gzip.compress(record(21))
    assert ids(data) == [20, 0, 1, 2, 3, 4, 21]
    (gap,) = gaps(data)
    start = len(gzip.compress(record(20)))
    assert start + len(cut) // 2 < gap[0] and gap[0] + gap[1] == start + len(cut)


def test_gaps_inside_a_sound_member_have_their_own_place():
    draw = __import__("random").Random(4)
    parts = [record(i, bytes(draw.randrange(256) for _ in range(3000)), "0" * 40 if i == 2 else None) for i in range(5)]
    packed = gzip.compress(b"".join(parts))
    rows = list(warc.salvage(packed))
    assert ids(packed) == [0, 1, 3, 4] and sum(r[2] for r in rows) == len(packed)
    (gap,) = gaps(packed)
    assert abs(gap[0] - len(packed) * 2 / 5) < 300 and abs(gap[1] - len(packed) / 5) < 300


def test_members_of_16_mb_and_more():
    big = "x" * (1 << 24)
    assert gzip.decompress(warc._packed(big) + b"\0") == (big + warc.SEPARATOR).encode()


def test_salvage_time_grows_with_the_bytes_only():
    import time

    def took(data, n):
        began = time.perf_counter()
        assert sum(x[0] == "record" for x in warc.salvage(data)) == n
        return time.perf_counter() - began

    draw = __import__("random").Random(5)
    member = [gzip.compress(record(i, draw.randbytes(1250).hex().encode())) for i in range(8000)]
    half, whole = took(b"".join(member[:4000]), 4000), took(b"".join(member), 8000)
    assert whole < 4 * half + 0.5
    broken = b"".join(m[:-6] + b"??????" if i % 3 == 0 else m for i, m in enumerate(member))  # each loses its record, whose checksum fails
    assert took(broken, 8000 - 2667) < 8 * whole + 2
    lines = b"WARC/1.1\r\nno: end\r\n"
    half, whole = took(lines * 40_000, 0), took(lines * 80_000, 0)
    assert whole < 4 * half + 0.5
    assert took(GZIP_START * 100_000 + record(1), 1) < 10


GZIP_START = gzip.compress(b"")[:10]


def test_one_damaged_member_of_many_records():
    draw = __import__("random").Random(6)
    packed = bytearray(gzip.compress(b"".join(record(i, draw.randbytes(3000)) for i in range(1000))))
    packed[len(packed) // 2] ^= 255
    found = ids(bytes(packed))
    assert found[:400] == list(range(400)) and gaps(bytes(packed))


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch, compression):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 16)
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 64)
    draw = random.Random(1)
    rows = [(i, "u", "".join(chr(draw.randrange(32, 127)) for _ in range(draw.choice([0, 10, 900, 20_000, 60_000])))) for i in range(60)] + [(99, "u", "x" * 150_000)]
    path = str(tmp_path / compression)
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path, compression)
    sizes = [f.stat().st_size for f in pathlib.Path(path).glob("part-*")]
    assert len(sizes) > 10 and sorted(sizes)[-2] < (1 << 16) + 64 * 700
    assert {(r.page_id, r.payload_bytes) for r in warc.read_warc(spark, path).where("kind = 'record'").collect()} == {(i, len(t)) for i, _, t in rows}


def test_lost_pages_fail_the_query(spark, monkeypatch):
    whole = warc.read_warc
    monkeypatch.setattr(warc, "read_warc", lambda spark, path: whole(spark, path).withColumn("kind", F.when(F.col("page_id") == 3, "gap").otherwise(F.col("kind"))))
    with pytest.raises(Exception, match="no record in bytes of"):
        queries.op10_warc(spark, "/root/testdata/sf0.001").collect()
