"""WARC archives: writing web records in segments, and reassembling them.

A record's HTTP block is framed as chunks and, beyond ``segment_bytes``, split into a first segment and continuation
records. Each record is compressed by itself, as the format asks, so that it can be read from its own offset. Reading groups
continuation records by the identifier of their origin, orders them by segment number, checks the total length and decodes
the chunked framing. Equal payloads are stored once: later records revisit them.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import new_path, small_batches

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
RECORD = "record_id string, type string, uri string, digest string, length long, refers_to string, segment int, origin string, total long, block binary"
PAGE = "record_id string, type string, uri string, payload_bytes long, payload_digest string, refers_to string, payload binary, valid boolean"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _cut(data: bytes, size: int) -> list[bytes]:
    """Pieces of about ``size`` bytes that end at UTF-8 characters, so that archives stay text."""
    out, i = [], 0
    while i < len(data):
        j = min(len(data), i + size)
        while j < len(data) and j > i + 1 and data[j] & 0xC0 == 0x80:
            j -= 1
        out.append(data[i:j])
        i = j
    return out


def _header(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"


def records_of(record: str, url: str | None, payload: bytes, payload_digest: str, refers_to: str | None, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """A page's records, whole: one response with any continuations, or one revisit. ``record`` and ``refers_to`` name records."""
    name, clean = f"<urn:page:{record}>", (url or "").replace("\r", "%0D").replace("\n", "%0A")
    known = [("WARC-Record-ID", name), ("WARC-Target-URI", clean), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("WARC-X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        block = _HTTP + b"\r\n"
        return [_header([("WARC-Type", "revisit"), *known, ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"]
    chunked = b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in _cut(payload, chunk_bytes)) + b"0\r\n\r\n"
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked
    parts = _cut(block, segment_bytes)
    out = []
    for i, part in enumerate(parts, 1):
        fields = [("WARC-Type", "response"), *known] if i == 1 else [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{record}:segment:{i}>"), ("WARC-Segment-Origin-ID", name)]
        if len(parts) > 1:
            fields.append(("WARC-Segment-Number", str(i)))
            if i == len(parts):
                fields.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_header([*fields, ("Content-Length", str(len(part)))]) + part + b"\r\n\r\n")
    return out


def members(archive: bytes):
    """The gzip members of an archive one by one, past zero bytes between or after them; an archive that isn't compressed as it is."""
    if archive[:2] != b"\x1f\x8b":
        yield archive
        return
    rest = archive
    while rest[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(31)
        try:
            data = one.decompress(rest)
        except zlib.error:
            return
        if not one.eof:
            return
        yield data
        rest = one.unused_data.lstrip(b"\0") if one.unused_data[:1] == b"\0" else one.unused_data


def parse(archive: bytes):
    """The records of an archive, by their Content-Length; stops at what is not a record or is cut off."""
    for data in members(archive):
        i = 0
        while data.startswith(b"WARC/", i) and (end := data.find(b"\r\n\r\n", i)) >= 0:
            fields = dict(line.split(b": ", 1) for line in data[i:end].split(b"\r\n")[1:] if b": " in line)
            size = int(fields.get(b"Content-Length", b"0"))
            start = end + 4
            if start + size > len(data):
                return
            yield fields, data[start : start + size]
            i = start + size + 4


def unframe(block: bytes) -> bytes | None:
    """The payload of an HTTP block; None if its head or chunked framing is broken."""
    head, end_of_head, body = block.partition(b"\r\n\r\n")
    if not end_of_head:
        return None
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, i = [], 0
    while (end := body.find(b"\r\n", i)) >= 0:
        try:
            size = int(body[i:end].split(b";")[0], 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(out)
        chunk = body[end + 2 : end + 2 + size]
        if len(chunk) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        out.append(chunk)
        i = end + 4 + size
    return None


def _written(segment_bytes: int, chunk_bytes: int, min_bytes: int):
    """One archive a task, of rows in order of what stands for their page_id, url and digest.

    Of rows that are alike in all three, only the first can be the response.
    """

    def run(batches):
        before, nth, out = None, 0, []
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("url", "hash", "record", "response")]
            payloads = batch["payload"].fill_null("").cast(pa.binary()).to_pylist()
            for url, h, record, response, payload in zip(*columns, payloads):
                nth = nth + 1 if record == before else 1
                before = record
                refers = None if len(payload) < min_bytes or (nth == 1 and record == response) else f"{response}:1"
                for r in records_of(f"{record}:{nth}", url, payload, base64.b32encode(bytes.fromhex(h)).decode(), refers, segment_bytes, chunk_bytes):
                    out.append(zlib.compress(r, 4, 31))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.large_binary())], ["value"])

    return run


def _name(page: Column, url: Column, h: Column) -> Column:
    """What stands for all rows of a page_id, url and payload."""
    spelled = F.concat(F.coalesce(F.concat(F.lit("u"), url), F.lit("-")), F.lit(" "), h)
    return F.concat(F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), F.substring(F.sha1(spelled), 1, 20))


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = 1 << 15, chunk_bytes: int = 1 << 13, file_bytes: int = 8 << 20) -> None:
    """Write a record for each row (page_id, url, payload) into archives of about ``file_bytes`` under ``path``.

    Of records with equal payloads of at least ``min_bytes``, that with the largest page_id is the response and the rest
    revisit it; null page_ids are below all others, ties go to the largest url, and of rows that are alike one is the
    response. Null payloads are empty; other columns are ignored; an empty table writes no record. Record ids are
    <urn:page:PAGE_ID:...>, each of its own, with ``null`` for a page without one.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("payload").cast("string"), F.lit("")).alias("payload")).withColumn("hash", F.sha1("payload"))
    # by payload: the greatest (has page_id, page_id, has url, url); only its key goes back to the rows
    kinds = rows.select("page_id", "url", "hash").distinct()
    rank = F.struct(F.col("page_id").isNotNull().alias("a"), F.col("page_id").alias("page_id"), F.col("url").isNotNull().alias("b"), F.col("url").alias("url"))
    responses = kinds.groupBy("hash").agg(F.max(rank).alias("r"))
    plan = kinds.join(responses, "hash").select(_name(F.col("page_id"), F.col("url"), F.col("hash")).alias("record"), _name(F.col("r.page_id"), F.col("r.url"), F.col("hash")).alias("response"))
    total = pages.agg(F.sum(F.octet_length("payload")), F.count("*")).first()
    tasks = int((total[0] or 0) + 400 * total[1]) // file_bytes + 1
    named = rows.withColumn("record", _name(F.col("page_id"), F.col("url"), F.col("hash")))
    dealt = named.repartition(tasks, "record").join(plan, "record").select("url", "hash", "record", "response", "payload").sortWithinPartitions("record")
    archives = dealt.mapInArrow(_written(segment_bytes, chunk_bytes, min_bytes), "value binary")
    # one archive a row and file; the bytes stay as they are, and the line end is a zero byte, which gzip allows at the end
    archives.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def _parsed(batches):
    name = lambda f, k: f[k].decode() if k in f else None
    number = lambda f, k: int(f[k]) if k in f else None
    for batch in batches:
        for archive in batch["content"]:
            rows, held = [], 0
            for f, block in parse(archive.as_py()):
                rows.append((name(f, b"WARC-Record-ID"), name(f, b"WARC-Type"), name(f, b"WARC-Target-URI"), (name(f, b"WARC-Payload-Digest") or "").removeprefix("sha1:") or None, number(f, b"WARC-X-Payload-Length"), name(f, b"WARC-Refers-To"), number(f, b"WARC-Segment-Number"), name(f, b"WARC-Segment-Origin-ID"), number(f, b"WARC-Segment-Total-Length"), block))
                held += len(block)
                if held > 4 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


_RECORD = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("digest", pa.string()), ("length", pa.int64()), ("refers_to", pa.string()), ("segment", pa.int32()), ("origin", pa.string()), ("total", pa.int64()), ("block", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORD)], schema=_RECORD)


def _joined(batches):
    """Records of segments: their blocks put together if they are 1 to n and add up to the total length."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            parts = sorted(row["s"], key=lambda x: x["segment"])
            whole = [x["segment"] for x in parts] == list(range(1, len(parts) + 1)) and sum(len(x["block"]) for x in parts) == row["total"]
            rows.append((*(row[c] for c in _HEAD), b"".join(x["block"] for x in parts) if whole else None))
        columns = list(zip(*rows)) if rows else [()] * (len(_HEAD) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(c, _RECORD.field(n).type) for n, c in zip((*_HEAD, "block"), columns)], [*_HEAD, "block"])


_HEAD = ("record_id", "type", "uri", "digest", "length", "refers_to")


def _unframed(batches):
    for batch in batches:
        kinds, blocks = batch["type"].to_pylist(), batch["block"].to_pylist()
        payloads = [None if k == "revisit" or b is None else unframe(b) for k, b in zip(kinds, blocks)]
        sizes = [n if p is None else len(p) for p, n in zip(payloads, batch["length"].to_pylist())]
        digests = [d if p is None else digest(p) for p, d in zip(payloads, batch["digest"].to_pylist())]
        valid = [k == "revisit" or (p is not None and d == e) for k, p, d, e in zip(kinds, payloads, digests, batch["digest"].to_pylist())]
        yield pa.RecordBatch.from_arrays([batch["record_id"], batch["type"], batch["uri"], pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), batch["refers_to"], pa.array(payloads, pa.binary()), pa.array(valid, pa.bool_())], ["record_id", "type", "uri", "payload_bytes", "payload_digest", "refers_to", "payload", "valid"])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under ``path``, whole: one row per response or revisit.

    Segments are put together; a record whose segments are not 1 to n, or do not add up to the total length, or whose framing or
    digest is wrong, has valid false (and a null payload if it can't be decoded). A revisit's size and digest are those of the
    full payload. Archives must fit a task's memory (``write_pages`` keeps them small).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    records = files.mapInArrow(_parsed, RECORD)
    whole = records.where("segment is null and coalesce(type, '') <> 'continuation'")
    parts = records.where("segment is not null").withColumn("of", F.coalesce("origin", "record_id"))
    held = parts.groupBy("of").agg(F.collect_list(F.struct("segment", "block")).alias("s"), F.max("total").alias("total"), *(F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("record_id", "type", "uri", "digest", "length", "refers_to")))
    kind = "record_id string, type string, uri string, digest string, length long, refers_to string, block binary"
    joined = held.where("record_id is not null").select("s", "total", *_HEAD).mapInArrow(_joined, kind)
    return whole.select(*_HEAD, "block").unionByName(joined).mapInArrow(_unframed, PAGE)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages into the session's shared folder and read the archives back."""
    path = new_path(pages.sparkSession, "warc")
    write_pages(pages, path, min_bytes)
    return read_pages(pages.sparkSession, path)
