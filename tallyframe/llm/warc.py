"""WARC archives: a writer on Spark's text sink and a splittable reader.

Writing.  Every record is a gzip member of its own.  Members leave through the
text sink (any store Spark can write, with its commit protocol): a gzip member of
less than 16 MB ends in a zero byte, so the sink's line separator is that byte
and the member goes without it.  Longer payloads get an empty member after them,
which ends in zero, too.  The files are plain multi-member gzip WARC files.

Reading.  The archives' sizes come from Spark's file listing; tasks take byte
ranges ``[from, to)`` of them, scan for the gzip magic, validate each candidate by
inflating it until a WARC header block parses, and read the records that start
inside their range, across its end if need be.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an archive that one task scans.
RANGE_BYTES = 16 << 20
#: Smaller payloads are always stored.
MIN_REVISIT_BYTES = 1000

MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/\d\.\d\r\n")
_EMPTY = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + bytes(8)

RECORD = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("record_type", T.StringType()),
    T.StructField("record_id", T.StringType()), T.StructField("target_uri", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("payload_length", T.LongType()), T.StructField("payload", T.BinaryType())])


def member(head: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member that ends in a zero byte."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(block)))])
    raw = b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    out = pack.compress(raw) + pack.flush()
    return out if out[-1] == 0 else out + _EMPTY


def _line(text) -> str:
    return re.sub(r"[\r\n]+", " ", text or "")


def _members(batches):
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            payload, kind = r["payload"] or b"", "response" if r["refers_to"] is None else "revisit"
            head = [("WARC-Type", kind)]
            if r["record_id"] is not None:
                head.append(("WARC-Record-ID", f"<urn:page:{r['record_id']}>"))
            head += [("WARC-Target-URI", _line(r["target_uri"])), ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"),
                     ("X-Payload-Length", str(len(payload)))]
            if kind == "revisit":
                head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                         ("WARC-Refers-To", f"<urn:page:{r['refers_to']}>")]
                payload = b""
            out.append(member(head, payload)[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["m"])


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write one record per row: the row with the largest id among equal
    payloads of at least ``MIN_REVISIT_BYTES`` bytes is a response, the others
    are revisits of it without payload; all other rows are responses.

    A null payload is empty, a null url an empty URI; a row without an id is
    written without a record id and is always a response.  Rows with equal id and
    payload are all responses or all revisits.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("record_id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload"))
    # narrow rows alone look for copies: digest, length and id, combined before the shuffle
    copies = (rows.filter((F.octet_length("payload") >= MIN_REVISIT_BYTES) & F.col("record_id").isNotNull())
              .groupBy("payload_digest", F.octet_length("payload").alias("size")).agg(F.max("record_id").alias("kept"), F.min("record_id").alias("least"))
              .filter("least < kept").select("payload_digest", "size", "kept"))
    joined = rows.withColumn("size", F.octet_length("payload")).join(copies.hint("shuffle_hash"), ["payload_digest", "size"], "left")
    records = joined.select("record_id", "target_uri", "payload", "payload_digest",
                            F.when(F.col("record_id") < F.col("kept"), F.col("kept")).alias("refers_to"))
    # raw bytes pass through a string column untouched
    (records.mapInArrow(_members, "m binary").select(F.col("m").cast("string").alias("value"))
     .write.option("lineSep", "\0").text(path))


class _Bytes:
    """A file as a sliding window of bytes."""

    def __init__(self, file, at: int, step: int = 1 << 18):
        self.file, self.at, self.step, self.buf = file, at, step, b""
        file.seek(at)

    def fill(self, n: int) -> bool:
        """Hold ``n`` bytes from ``at``, if the file has them."""
        while len(self.buf) < n:
            more = self.file.read(max(self.step, n - len(self.buf)))
            if not more:
                return False
            self.buf += more
        return True

    def skip(self, n: int) -> None:
        self.buf = self.buf[n:]
        self.at += n


def _inflate(window: _Bytes):
    """(record, compressed length) of the member at the window's start; None
    for the record of an empty member, None altogether if it is not one."""
    unpack, out, used = zlib.decompressobj(31), [], 0
    checked = False
    try:
        while not unpack.eof:
            if used >= len(window.buf) and not window.fill(used + 1):
                return None
            piece = window.buf[used: used + (1 << 18)]
            out.append(unpack.decompress(piece))
            used += len(piece)
            if not checked and sum(map(len, out)) >= 10:
                if not _VERSION.match(b"".join(out)):
                    return None
                checked = True
    except zlib.error:
        return None
    used -= len(unpack.unused_data)
    raw = b"".join(out)
    if not raw:
        return None, used
    if not _VERSION.match(raw):
        return None
    head, sep, rest = raw.partition(b"\r\n\r\n")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]))
    length = fields.get("content-length", "")
    if not sep or "warc-type" not in fields or not length.isdigit() or len(rest) < int(length):
        return None
    return (fields, rest[: int(length)]), used


def scan(file, size: int, lo: int, hi: int) -> Iterator[tuple[int, dict, bytes]]:
    """(offset, header fields, block) of the records that start in ``[lo, hi)``."""
    window = _Bytes(file, lo)
    while window.at < min(hi, size):
        if not window.fill(len(MAGIC)):
            return
        at = window.buf.find(MAGIC)
        if at < 0:
            window.skip(len(window.buf) - len(MAGIC) + 1)
            continue
        window.skip(at)
        if window.at >= hi:
            return
        got = _inflate(window)
        if got is None:  # the magic by chance, within another member
            window.skip(1)
            continue
        record, used = got
        if record is not None:
            yield window.at, record[0], record[1]
        window.skip(used)


def _read_ranges(batches):
    for batch in batches:
        for r in batch.to_pylist():
            store, path = pyarrow.fs.FileSystem.from_uri(r["path"])
            rows, held = [], 0
            with store.open_input_file(path) as file:
                for offset, f, block in scan(file, r["size"], r["lo"], r["hi"]):
                    text = f.get("x-payload-length", "")
                    rows.append({"path": r["path"], "offset": offset, "record_type": f["warc-type"], "record_id": f.get("warc-record-id"),
                                 "target_uri": f.get("warc-target-uri"), "refers_to": f.get("warc-refers-to"),
                                 "payload_digest": f.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                                 "payload_length": int(text) if text.isdigit() else len(block), "payload": block})
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


_ARROW = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
                    ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()),
                    ("payload_length", pa.int64()), ("payload", pa.binary())])


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of all archives under ``path``, read by byte ranges.

    Null where a record lacks a field; empty files give nothing; a damaged member
    is passed over, and reading goes on at the next valid one."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size")).filter("size > 0")
    parts = (files.withColumn("lo", F.explode(F.expr(f"sequence(0L, size - 1, {range_bytes}L)")))
             .withColumn("hi", F.least(F.col("lo") + range_bytes, F.col("size"))))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return parts.repartition(tasks, "path", "lo").mapInArrow(_read_ranges, RECORD)
