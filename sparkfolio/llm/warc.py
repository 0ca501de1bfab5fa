"""WARC archives: writing with revisits, segments and chunked transfer framing, and reading back with reassembly."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import cut, map_rows, parts_of, shared_dir, ship, table

#: Payloads from this size on are stored once; equal ones revisit the one with the smallest page_id.
REVISIT_BYTES = 100
#: Longest block of a record; a longer one continues in further records. With the records of a file this bounds a file's
#: size (RECORDS * (SEGMENT + 2 KiB) at most), which is what a reading task holds.
SEGMENT, RECORDS, CHUNK = 32 << 10, 1024, 8 << 10
#: Bytes of an archive that are inflated at a time.
WINDOW = 64 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def chunked(payload: bytes) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Raises ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        chunk = body[end + 2 : end + 2 + n]
        if len(chunk) < n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(chunk)
        at = end + 4 + n


def head(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace") + b"\r\n"


def records(page_id, url, payload: bytes, digest: str, refers_to) -> list[bytes]:
    """The record or records of a page."""
    own = f"<urn:page:{page_id}:sha256:{digest}>"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or f"urn:page:{page_id}"
    common = [("WARC-Date", DATE), ("WARC-Target-URI", target)]
    if refers_to is not None:
        block = HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}:sha256:{digest}>")]
        fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
        return [head(fields) + block + b"\r\n\r\n"]
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    segments = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    out = []
    for k, part in enumerate(segments, 1):
        fields = [("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", own if k == 1 else f"<urn:page:{page_id}:sha256:{digest}:{k}>"), *common]
        if k == 1:
            fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
        else:
            fields.append(("WARC-Segment-Origin-ID", own))
        if len(segments) > 1:
            fields.append(("WARC-Segment-Number", k))
            if k == len(segments):
                fields.append(("WARC-Segment-Total-Length", len(block)))
        out.append(head([*fields, ("Content-Length", len(part))]) + part + b"\r\n\r\n")
    return out


def members(archive: bytes):
    """The contents of an archive's gzip members, one after the other: a file of one member for all records gives one."""
    at, view = 0, memoryview(archive)
    while at < len(view):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut short")
            piece = view[at : at + WINDOW]
            parts.append(inflate.decompress(piece))
            at += len(piece) - len(inflate.unused_data)
        yield b"".join(parts)


def parsed(archive: bytes):
    """(fields, block) of every record of an uncompressed archive; field names in lower case. Raises ValueError on broken framing."""
    at = 0
    while at < len(archive):
        end = archive.find(b"\r\n\r\n", at)
        if end < 0 or archive[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        lines = archive[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        begin, n = end + 4, int(fields["content-length"])
        if archive[begin + n : begin + n + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has another length")
        yield fields, archive[begin : begin + n]
        at = begin + n + 4


def payload_of(block: bytes) -> tuple[bytes, int]:
    """The decoded payload of an HTTP response and its length; of a response without body, the length that it states."""
    header, _, body = block.partition(b"\r\n\r\n")
    if re.search(rb"(?i)\r\nTransfer-Encoding:[ \t]*chunked", header):
        payload = dechunked(body)
        return payload, len(payload)
    stated = re.search(rb"(?i)\r\nContent-Length:[ \t]*(\d+)", header)
    return body, int(stated[1]) if stated else len(body)


def page_of(record_id: str | None):
    found = re.match(r"<urn:page:(-?\d+):", record_id or "")
    return int(found[1]) if found else None


def member(record: bytes) -> bytes:
    """A record as a gzip member of its own, so that an archive can be read from any record's offset.

    Without its last byte, which is the highest byte of the record's length and so zero below 16 MiB: it comes back as the
    separator that the text writer puts after each row.
    """
    made = zlib.compress(record, 6, 31)
    if made[-1]:
        raise ValueError("a record is longer than 16 MiB")
    return made[:-1]


def write_archives(pages: DataFrame, folder: str) -> None:
    """Writes a record for every row of pages (page_id, url, html) into archive files under folder, each a sequence of gzip members.

    A null html is an empty payload. Of rows with equal payloads of at least REVISIT_BYTES bytes, those with the smallest
    page_id are responses, the others revisits; null ids sort last. Which row revisits which page is found on ids and
    digests alone; payloads then meet what their row revisits by page_id and digest, not by a digest that a third of all pages
    may share.
    """
    ship(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    large = table(rows.where(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", "digest"))
    firsts = table(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("_digest"), "first"))
    again = large.join(firsts, F.col("digest") == F.col("_digest")).where(~F.col("page_id").eqNullSafe(F.col("first")))
    again = table(again.select(F.col("page_id").alias("_page"), F.col("digest").alias("_key"), "first").distinct())
    joined = rows.join(again.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_key")), "left")
    schema = pa.schema([("record", pa.binary())])

    def run(batches):
        for batch in parts_of(batches):
            made = [member(r) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in records(*row)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], schema=schema)

    made = joined.select("page_id", "url", "payload", "digest", "first").mapInArrow(run, "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.option("maxRecordsPerFile", RECORDS).option("lineSep", "\0").text(folder)


RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, problem string"
PARSED = f"{RESULT}, origin string, number int, total long, block binary"


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, problem for every response and revisit in folder's archives.

    Records in one piece are decoded where they are read. Segments are grouped by their origin's id, ordered by number and
    joined if they are complete and as long in all as the last one states; only segments are shuffled. The digest is that of
    the decoded payload, of a revisit that which it states. problem says why a payload couldn't be read or that its digest
    isn't the one stated, else it is null. A file is read as a whole, so it has to be below 2 GB; write_archives() bounds its own.
    """
    ship(spark)
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(PARSED))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                out = []
                records = (r for m in members(batch.column(0)[i].as_py()) for r in parsed(m))
                for fields, block in records:
                    kind, own = fields.get("warc-type"), fields.get("warc-record-id")
                    if kind == "continuation" or "warc-segment-number" in fields:
                        origin = fields.get("warc-segment-origin-id", own)
                        total = fields.get("warc-segment-total-length")
                        out.append((page_of(origin), None, stated(fields), "response", None, None, origin, int(fields["warc-segment-number"]), int(total) if total else None, block))
                    elif kind in ("response", "revisit"):
                        size, sha, problem = read_block(block, stated(fields), kind == "revisit")
                        out.append((page_of(own), size, sha, kind, page_of(fields.get("warc-refers-to")), problem, None, None, None, None))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    found = cut(files.mapInArrow(run, PARSED))
    names = [x.split(" ")[0] for x in RESULT.split(", ")]
    segments = found.where("origin is not null").groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("number", "total", "block", "payload_digest"))).alias("segments"))

    def step(cols):
        out = []
        for origin, parts in zip(*cols, strict=True):
            copies = sum(p["number"] == 1 for p in parts) or 1  # repeated rows have equal segments
            once = parts[::copies]
            block = b"".join(p["block"] for p in once)
            if [p["number"] for p in once] != list(range(1, len(once) + 1)) or once[-1]["total"] is None:
                got = (None, None, "a segment is missing")
            elif once[-1]["total"] != len(block):
                got = (None, None, f"segments have {len(block)} bytes, {once[-1]['total']} are stated")
            else:
                got = read_block(block, once[0]["payload_digest"], False)
            out += [(page_of(origin), *got[:2], "response", None, got[2])] * copies
        return list(zip(*out, strict=True))

    return found.where("origin is null").select(*names).unionByName(map_rows(segments, lambda: step, RESULT))


def stated(fields: dict) -> str | None:
    """The payload digest that a record states, bare."""
    found = fields.get("warc-payload-digest")
    return found and found.removeprefix("sha256:")


def read_block(block: bytes, digest: str | None, revisit: bool) -> tuple:
    """(payload bytes, payload digest, problem); digest: what the record states, which a payload is compared with."""
    try:
        payload, n = payload_of(block)
    except ValueError as e:
        return None, None, str(e)
    if revisit:
        return n, digest, None
    own = hashlib.sha256(payload).hexdigest()
    return n, own, None if digest in (None, own) else f"the payload's digest is not {digest}, as is stated"


def through_archives(pages: DataFrame) -> DataFrame:
    """read_archives() of what write_archives() makes of pages, in a new folder within the shared one. The archives stay there.

    A page of a null, empty or very long html, without url or page_id, or repeated has a row each; an empty table gives an
    empty one. Columns other than page_id, url and html are not read.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    return read_archives(spark, folder)


SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= {REVISIT_BYTES} GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest, CASE WHEN f.first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN f.first <> page_id THEN f.first END AS refers_to, NULL::VARCHAR AS problem
FROM p LEFT JOIN f ON f.d = p.d AND p.n >= {REVISIT_BYTES}
"""
