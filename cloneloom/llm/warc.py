"""WARC archives: a writer on Spark's text sink and a salvage reader.

Writing: each page becomes one WARC/1.1 record.  Spark's text writer puts the records of a partition into
one file, so commits, retries and lost executors are the writer's business: plain records with the record
separator CRLF CRLF as line separator, or one gzip member per record, built in the task.  Of equal payloads of at least
``min_revisit`` bytes the page with the largest id keeps its payload; the others become revisit records that name it.

Reading: every record is checked (version line, header block, Content-Length, separator, block digest;
for gzip files each member's own checksum).  After a failed check the reader looks for the next place where a
valid member or version line begins, goes on there and logs the bytes between as a quarantined gap.  Of a
member that fails, the records that did unpack are checked and kept, but for the one at whose end it failed; they
and gaps inside a member have the places of the packed bytes that hold them.  Records of a sound member have
the member's place.

Edge cases: null html is an empty payload; a null url gives no target line; line breaks in a url are dropped;
rows that repeat an id and payload stay separate records; null ids are responses; an empty table gives an
archive without records; other columns are ignored, whatever their names.  Very long payloads are records like any
other; a task holds one archive file (2 GB at most) and one member unpacked.  Reading takes time in proportion to the bytes, damaged or not.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
SEPARATOR = CRLF * 2
ID = "urn:page:"
GZIP = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: A version line on a line of its own, which no header block has inside.
VERSION_LINE = re.compile(rb"(?<=\n)WARC/1\.[01]\r\n")
#: Bytes of a damaged member between places that are known both packed and unpacked.
MARK = 64
#: Records in an archive, and bytes of their payloads.
RECORDS_PER_FILE, FILE_BYTES = 2000, 1 << 29
#: The highest byte of a member's length, which ends it, is zero below 16 MB; an empty member ends in zeros always.
MEMBER_END, EMPTY_MEMBER = "\0", gzip.compress(b"", mtime=0)
FOUND = (
    "path string, kind string, at long, n_bytes long, reason string, page_id long, record_type string, "
    "refers_to long, payload_bytes long, payload_digest string, url string, payload binary"
)


def plan_records(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """pages with payload, payload_bytes, payload_digest, record_type and refers_to."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        "page_id", "url", payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload.cast("binary")).alias("payload_digest"),
    )
    large = rows.where(F.col("payload_bytes") >= min_revisit).select("page_id", "payload_bytes", "payload_digest")
    kept = large.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = large.join(kept, ["payload_digest", "payload_bytes"]).where("page_id <> refers_to").select("page_id", "payload_digest", "refers_to").distinct()
    return rows.join(revisits, ["page_id", "payload_digest"], "left").withColumn(
        "record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    )


def as_record(date: str = "2024-01-01T00:00:00Z") -> F.Column:
    """The text of one record without the closing separator."""
    block = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.col("payload"))

    def line(name, *value):
        return F.concat(F.lit(f"{name}: "), *value, F.lit(CRLF))

    url = F.translate("url", "\r\n", "")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")),
        F.when(F.col("page_id").isNotNull(), line("WARC-Record-ID", F.lit(f"<{ID}"), F.col("page_id").cast("string"), F.lit(">"))).otherwise(""),
        line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", url)).otherwise(""),
        F.when(F.col("refers_to").isNotNull(), line("WARC-Refers-To", F.lit(f"<{ID}"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        line("WARC-Payload-Digest", F.lit("sha1:"), F.col("payload_digest")),
        line("WARC-Block-Digest", F.lit("sha1:"), F.sha1(block.cast("binary"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.lit(f"Content-Type: text/html; charset=utf-8{CRLF}"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )


def _packed(record: str) -> bytes:
    """The record and its separator as a gzip member, without the zero byte at its end."""
    member = gzip.compress((record + SEPARATOR).encode(), 6, mtime=0)
    return (member if member[-1] == 0 else member + EMPTY_MEMBER)[:-1]


def _members(records: F.Column) -> F.Column:
    @F.pandas_udf("binary")
    def packed(records: pd.Series) -> pd.Series:
        return records.map(_packed)

    return packed(records)


def write_warc(pages: DataFrame, path: str, compression: str = "none", min_revisit: int = 1000) -> None:
    """Archives of at most RECORDS_PER_FILE records: plain ('none') or with a gzip member per record ('gzip').

    Pages of which so many would pass FILE_BYTES are written apart, by sizes up to a power of two, so many to a file as fit.
    """
    if compression not in ("none", "gzip"):
        raise ValueError(f"compression {compression}")
    record = as_record()
    value = record if compression == "none" else _members(record).cast("string")  # the sink writes the bytes as they are
    least = max(0, (FILE_BYTES // RECORDS_PER_FILE).bit_length() - 1)
    octets = F.coalesce(F.octet_length("html"), F.lit(0))
    power = F.greatest(F.lit(least), F.ceil(F.log2(F.greatest(octets, F.lit(1)))).cast("int"))
    powers = [r[0] for r in pages.select(power.alias("power")).distinct().orderBy("power").collect()] or [least]  # 31 at most
    rows = plan_records(pages, min_revisit)
    for i, p in enumerate(powers):
        octets = F.greatest("payload_bytes", F.lit(1))
        some = rows.where(F.greatest(F.lit(least), F.ceil(F.log2(octets)).cast("int")) == p) if len(powers) > 1 else rows
        (
            some.select(value.alias("value")).write.mode("append" if i else "overwrite")
            .option("lineSep", SEPARATOR if compression == "none" else MEMBER_END).option("maxRecordsPerFile", min(RECORDS_PER_FILE, max(1, FILE_BYTES >> p)))
            .text(path)
        )


def _headers(block: bytes) -> dict[str, str]:
    pairs = (line.split(b":", 1) for line in block.split(b"\r\n")[1:] if b":" in line)
    return {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, v in pairs}


class _Seen:
    """Where the next header end, version line and gzip member are; each search goes on where the last one ended, so all of them read the bytes once."""

    def __init__(self, data: bytes):
        self.data, self.last = data, {}

    def find(self, what: bytes | re.Pattern, at: int) -> int:
        """The first place from ``at`` on, or -1; places asked for one kind never go back by more than a record."""
        start, found = self.last.get(what, (0, -2))
        if not start <= at or found != -1 and found < at:
            if isinstance(what, bytes):
                found = self.data.find(what, at)
            else:
                match = what.search(self.data, at)
                found = match.start() if match else -1
            self.last[what] = at, found
        return found


def _plain_record(data: bytes, at: int, seen: _Seen):
    """(end, headers, block) of the record at that place, or why there is none."""
    if not VERSION.match(data, at):
        return "no version line"
    body, other = seen.find(b"\r\n\r\n", at), seen.find(VERSION_LINE, at + 1)
    if body < 0 or 0 <= other < body:
        return "header without end"
    headers, body = _headers(data[at:body]), body + 4
    if not headers.get("content-length", "").isdigit():
        return "no length"
    end = body + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return "wrong length"
    block, digest = data[body:end], headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and hashlib.sha1(block).hexdigest() != digest[5:].lower():
        return "wrong digest"
    return end + 4, headers, block


def _member(data: bytes, at: int) -> tuple[int, bytes, list[tuple[int, int]], str]:
    """The gzip member at that place: its end, what could be unpacked, marks (packed, unpacked) on the way, and what is wrong with it.

    It is fed in growing pieces, so a false start costs little and the tail is never copied; a piece that fails is fed
    again in steps of MARK bytes, to keep what unpacks before the damage.
    """
    view, unpack, out, size = memoryview(data), zlib.decompressobj(31), [], 0
    marks, step, why = [(at, 0)], 256, ""
    while not unpack.eof:
        if at >= len(data):
            why = "gzip: cut off"
            break
        before = unpack.copy()
        try:
            part = unpack.decompress(view[at : at + step])
        except zlib.error as err:
            if step > MARK:
                unpack, step = before, MARK
                continue
            why = f"gzip: {err}"
            break
        at = min(at + step, len(data)) - len(unpack.unused_data)
        size += len(part)
        out.append(part)
        marks.append((at, size))
        step = step if step == MARK else min(2 * step, 1 << 16)
    return at, b"".join(out), marks, why


def _inside(out: bytes, marks: list[tuple[int, int]], whole: bool) -> list[tuple]:
    """The rows of a member that has gaps or fails, at the places of their packed bytes; of one that fails only up to its last good record."""
    rows = list(salvage(out))
    if not whole:
        while rows and (rows[-1][0] == "gap" or rows[-1][1] + rows[-1][2] == len(out)):
            rows.pop()
    placed, last, sizes = [], marks[0][0], [size for _, size in marks]
    for kind, start, n, *rest in rows:
        end = marks[bisect_left(sizes, start + n)][0]
        placed.append((kind, last, end - last, *rest))
        last = end
    if whole and placed:  # the end of the member belongs to its last row
        kind, start, _, *rest = placed[-1]
        placed[-1] = (kind, start, marks[-1][0] - start, *rest)
    return placed


def _finer(data: bytes, at: int, end: int) -> list[tuple[int, int]]:
    """Marks at every MARK bytes of a sound member."""
    view, unpack, marks, size = memoryview(data), zlib.decompressobj(31), [(at, 0)], 0
    for i in range(at, end, MARK):
        size += len(unpack.decompress(view[i : min(i + MARK, end)]))
        marks.append((min(i + MARK, end), size))
    return marks


def salvage(data: bytes) -> Iterator[tuple]:
    """('record', at, length, headers, block) and ('gap', at, length, reason, b'') in the order of the bytes."""
    at, bad, why, seen = 0, None, "", _Seen(data)
    while at < len(data):
        if data.startswith(GZIP, at):
            end, out, marks, wrong = _member(data, at)
            if wrong:
                kept = _inside(out, marks, False) if out else []
                if kept:
                    if bad is not None:
                        yield "gap", bad, at - bad, why, b""
                    yield from kept
                    bad = at = kept[-1][1] + kept[-1][2]
                    why = wrong
                    at -= 1  # the search below begins where the last good record ends
                elif bad is None:
                    bad, why = at, wrong
                found = wrong
            else:
                rows = list(salvage(out))
                gaps = any(r[0] == "gap" for r in rows)
                found = end, _inside(out, _finer(data, at, end), True) if gaps else [(k, at, end - at, *rest) for k, _, _, *rest in rows]
        else:
            got = _plain_record(data, at, seen)
            found = got if isinstance(got, str) else (got[0], [("record", at, got[0] - at, got[1], got[2])])
        if isinstance(found, str):
            if bad is None:
                bad, why = at, found
            at = min([x for x in (seen.find(VERSION, at + 1), seen.find(GZIP, at + 1)) if x >= 0], default=len(data))
            continue
        if bad is not None:
            if at > bad:
                yield "gap", bad, at - bad, why, b""
            bad = None
        yield from found[1]
        at = found[0]
    if bad is not None:
        yield "gap", bad, len(data) - bad, why, b""


def _rows(path: str, data: bytes, payloads: bool) -> Iterator[tuple]:
    def number(text):
        tail = text.strip("<>").removeprefix(ID) if text else ""
        return int(tail) if re.fullmatch(r"-?\d+", tail) else None

    for kind, at, n, what, block in salvage(data):
        if kind == "gap":
            yield path, kind, at, n, what, *[None] * 7
            continue
        get = what.get
        revisit = get("warc-type") == "revisit"
        size = int(get("x-payload-length", "-1")) if revisit else len(block)
        digest = get("warc-payload-digest", "").removeprefix("sha1:") if revisit else hashlib.sha1(block).hexdigest()
        yield (path, kind, at, n, None, number(get("warc-record-id")), get("warc-type"), number(get("warc-refers-to")),
               size, digest, get("warc-target-uri"), block if payloads else None)


def read_warc(spark, path: str, payloads: bool = False, names: str = "*") -> DataFrame:
    """Rows of FOUND: kind 'record' for what passed its checks, kind 'gap' for quarantined bytes; names is a pattern of file names."""
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in FOUND.split(", "))])

    def read(batches):
        for batch in batches:
            for path, data in zip(batch.column("path"), batch.column("content")):
                rows, n = [], 0
                for row in _rows(path.as_py(), data.as_py(), payloads):
                    rows.append(row)
                    n += len(row[-1] or b"") + 200
                    if n > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, n = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(path).select("path", "content")
    return files.mapInArrow(read, FOUND)
