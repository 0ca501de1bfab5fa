"""Document fingerprints: quartile bucket digests of hashed byte triplets."""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import map_rows, ship, table

#: Buckets of a digest; each holds a quartile code of two bits.
BUCKETS = 1024
#: Distances of a triplet's second and third byte from its first. Wide triplets differ between texts of one language.
SHAPES = ((3, 7), (5, 12))
#: Part of the score that the lengths can take away.
LENGTH_SHARE = 0.1


def codes_of(raw: bytes) -> tuple[np.ndarray, int]:
    """Quartile codes (0 to 3) of the buckets' counts, and the length on a logarithmic scale (0 for no bytes)."""
    whole = np.frombuffer(raw, np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    for k, (second, third) in enumerate(SHAPES):
        b = whole
        if len(b):
            if len(b) <= third:  # a short text goes round
                b = np.resize(b, len(b) + third)
            h = b[: len(b) - third] * np.uint32(0x9E3779B1) + b[second : len(b) - third + second] * np.uint32(0x85EBCA77) + b[third:] * np.uint32(0xC2B2AE3D)
            h ^= h >> np.uint32(15 + k)
            h *= np.uint32(0x27D4EB2F)
            counts += np.bincount(h >> np.uint32(22), minlength=BUCKETS)
    q1, q2, q3 = np.partition(counts, (BUCKETS // 4, BUCKETS // 2, 3 * BUCKETS // 4))[[BUCKETS // 4, BUCKETS // 2, 3 * BUCKETS // 4]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    return codes.astype(np.uint8), round(8 * math.log2(1 + len(raw)))


def digest(codes: np.ndarray, length: int) -> bytes:
    c = codes.reshape(-1, 4)
    packed = c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6
    return length.to_bytes(2, "big") + packed.astype(np.uint8).tobytes()


def encoded(codes: np.ndarray, length: int) -> str:
    return base64.b64encode(digest(codes, length)).decode()


def decoded(text: str) -> tuple[np.ndarray, int]:
    raw = base64.b64decode(text)
    packed = np.frombuffer(raw[2:], np.uint8)
    return np.stack([packed >> s & 3 for s in (0, 2, 4, 6)], axis=1).reshape(-1), int.from_bytes(raw[:2], "big")


def likeness(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int]) -> float:
    """From 0 to 1: one less the digests' distance over the distance to expect of unrelated digests with the same codes.

    1 for equal digests. Lengths that differ by a factor of 4 or more take a tenth away.
    """
    far = int(np.abs(a[0].astype(np.int8) - b[0].astype(np.int8)).sum())
    p, q = np.bincount(a[0], minlength=4), np.bincount(b[0], minlength=4)
    expected = sum(int(p[i]) * int(q[j]) * abs(i - j) for i in range(4) for j in range(4)) / BUCKETS
    same = 1.0 - far / expected if expected else float(far == 0)
    return max(0.0, min(1.0, same)) * (1 - LENGTH_SHARE * min(1.0, abs(a[1] - b[1]) / 16))


def fingerprint_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint for every text; null counts as empty. Equal texts have equal fingerprints. No shuffle.

    Repeated rows and null ids give a row each, an empty table none; a very long text is counted whole. Other columns are not read.
    """
    ship(docs.sparkSession)

    def step(cols):
        texts = [x or "" for x in cols[1]]
        return [cols[0], list(map(len, texts)), [encoded(*codes_of(x.encode("utf-8", "replace"))) for x in texts]]

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), lambda: step, "doc_id long, n_chars long, fingerprint string")


def edited_with_next(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: As tables hold a comparison: digests in bytes.
FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def compared(doc_id, text: str, own, following: str, next_codes) -> tuple:
    edited = edited_with_next(text, following).encode("utf-8", "replace")
    changed = codes_of(edited)
    return doc_id, len(text), hashlib.sha256(edited).digest(), digest(*own), digest(*changed), likeness(own, changed), likeness(own, next_codes)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, a row per row of docs.

    The next document is the next row by (doc_id, CRC-32 of the text, text), after the last the first; null ids come first, null
    texts count as empty, repeated rows follow one another, in one range. An empty table gives an empty one; other columns
    are not read, whatever they are called. Rows are dealt by ranges of (doc_id, CRC-32) and sorted, once; a task streams
    through its range and holds two texts. One pass gives the results and the range's first and last text, a row for each
    range, and is written to the shared folder: which rows a range has is decided once, whatever is reused or run again. The
    ends are then matched up among themselves: the only rows that meet beyond a range.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.withColumn("_h", F.crc32(F.col("text").cast("binary")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = ordered.repartitionByRange(n, "doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").select("doc_id", "text")
    ends_fields = [("range", pa.int64()), ("first", pa.string()), ("last", pa.string())]
    arrow = pa.schema(FIELDS + ends_fields)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    def inside(batches):
        """Every row of a range that has a next one there; at last the range's number, its last doc_id, its first and last text."""
        before, first, out = None, None, []
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_id, text = doc_id.as_py(), text.as_py()
                own = codes_of(text.encode("utf-8", "replace"))
                if before is None:
                    first = text
                else:
                    out.append((*compared(*before, text, own), None, None, None))
                    if len(out) >= 1000:
                        yield made(out)
                        out.clear()
                before = (doc_id, text, own)
        if before is not None:
            out.append((before[0], *[None] * (len(FIELDS) - 1), TaskContext.get().partitionId(), first, before[1]))
            yield made(out)

    schema = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    ranged = table(ranged.mapInArrow(inside, f"{schema}, range long, first string, last string"))
    ends = ranged.where("range is not null")
    by_range = Window.orderBy("range")  # a row for each shuffle partition
    whole = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pairs = ends.select("doc_id", "last", F.coalesce(F.lead("first").over(by_range), F.first("first").over(whole)).alias("_next"))

    def step(cols):
        made = []
        for doc_id, text, following in zip(*cols, strict=True):
            made.append(compared(doc_id, text, codes_of(text.encode("utf-8", "replace")), following, codes_of(following.encode("utf-8", "replace"))))
        return list(zip(*made, strict=True))

    every = ranged.where("range is null").select(*[name for name, _ in FIELDS]).unionByName(map_rows(pairs, lambda: step, schema))
    plain = lambda c: F.translate(F.base64(c), "\r\n", "")  # noqa: E731  some settings break lines
    shown = {"edited_sha256": F.lower(F.hex("edited_sha256")), "fingerprint": plain("fingerprint"), "edited_fingerprint": plain("edited_fingerprint")}
    return every.withColumns(shown)
