import gzip
import hashlib
import io
import os
import random

from pyspark.sql import functions as F

from tallyframe.llm import warc
from tallyframe.llm.warc import read_warc, write_warc
from tests.llm.brute import with_clash

PAGES = "page_id long, url string, html string"


def payloads(rng):
    big = "<p>" + "ü" * 700 + "</p>"
    noise = "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(40_000))
    rows = [(i, f"http://h{i % 3}.example/{i}\r\nX: y", rng.choice([big, noise, f"<b>{i}</b>", "x" * 999, "x" * 1000, "", None, big + str(i)])) for i in range(200)]
    return [*rows, (1000, None, big), (None, "u", big), (1000, None, big), (1001, "u", "\x1f\x8b\x08 magic \x1f\x8b\x08" * 200), (1002, "v", "WARC/1.1\r\n\r\n" * 300)]


def expected(rows):
    best = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= 1000:
            best[b] = max(best.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        r = best.get(b)
        refers = r if i is not None and r is not None and r != i else None
        out.append((str(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if refers is not None else "response", str(refers)))
    return sorted(out)


def digest(records):
    page = r"<urn:page:(-?\d+)>"
    got = records.select(F.regexp_extract("record_id", page, 1).try_cast("long").alias("i"), "payload_length", "payload", "payload_digest", "record_type",
                         F.regexp_extract("refers_to", page, 1).try_cast("long").alias("r")).collect()
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_length
        else:
            assert r.payload == b""
    return sorted((str(r.i), r.payload_length, r.payload_digest, r.record_type, str(r.r)) for r in got)


def test_round_trip_by_small_ranges(spark, scratch):
    rows = payloads(random.Random(1))
    path = os.path.join(scratch, "a")
    write_warc(with_clash(spark.createDataFrame(rows, PAGES).repartition(3)), path)
    for size in (700, 50_000, 1 << 24):
        assert digest(read_warc(spark, path, range_bytes=size)) == expected(rows)
    # plain multi-member gzip
    for name in os.listdir(path):
        if name.startswith("part-"):
            with gzip.open(os.path.join(path, name)) as f:
                assert f.read().count(b"WARC-Type: ") >= 1


def test_payload_whose_member_does_not_end_in_zero(spark, scratch):
    rows = [(1, "u", "ab" * (9 << 20)), (2, "v", "x")]
    path = os.path.join(scratch, "a")
    write_warc(spark.createDataFrame(rows, PAGES), path)
    assert digest(read_warc(spark, path, range_bytes=4096)) == expected(rows)


def test_no_pages(spark, scratch):
    path = os.path.join(scratch, "a")
    write_warc(spark.createDataFrame([], PAGES), path)
    assert read_warc(spark, path).count() == 0


def test_scan_passes_over_damage():
    head = [("WARC-Type", "response")]
    good = [warc.member(head, f"record {i}".encode() * 50) for i in range(3)]
    broken = good[1][: len(good[1]) // 2]
    data = b"junk" + good[0] + broken + b"\x1f\x8b\x08" + good[2]
    got = [(at, block[:8]) for at, _, block in warc.scan(io.BytesIO(data), len(data), 0, len(data))]
    assert got == [(4, b"record 0"), (len(data) - len(good[2]), b"record 2")]
