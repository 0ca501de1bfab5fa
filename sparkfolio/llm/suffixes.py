"""Passages that repeat anywhere in a corpus: suffixes in the order of a radix sort that ends at a given depth.

A window is a string of `length` bytes within a text. Windows are sorted from the most significant digit on, and what is alone
leaves after each pass; what is together at the full depth is a repeated window.

1. The first digit of a window is its anchor: of the strings of `core` bytes in it the one with the least hash. Equal windows have
   equal anchors at the same place, and about 128 windows in a row share one (a run), so the pass deals a row per run.
2. The second digit is the whole run: equal runs consist of repeated windows only, and one of each kind goes on.
3. Runs of different kinds with the same anchor are dealt by it, with their bytes, and a task sorts their windows by eight bytes
   at a time through `length`. Anchors with more kinds than a task should hold take one more pass of a wide digit instead:
   their windows are dealt one by one by a digest, counted before they are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import drop_tables, parts_of, ship, table

#: Bytes of a repeated window, as the query has it.
LENGTH = 400
#: Window starts that are looked at together, and bytes of runs that a task sorts together.
BLOCK, SORTED_BYTES = 1 << 18, 4 << 20
#: Kinds of runs of one anchor that are sorted in one task; more go by digests.
KINDS = 2048

_RNG = np.random.default_rng(20260)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_UP, _DOWN = (np.cumprod(np.append(np.uint64(1), np.full(2 * BLOCK, b, np.uint64)), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 2**64)))


def core_of(length: int) -> tuple[int, int]:
    """Bytes of an anchor, and places it can have in a window: a power of two, about two thirds of the window."""
    places = 1 << max(0, (2 * length // 3).bit_length() - 1)
    return length - places + 1, places


def hashes(b: np.ndarray, core: int) -> np.ndarray:
    """A 64-bit hash of each string of core bytes."""
    with np.errstate(over="ignore"):
        up_to = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[b] * _UP[: len(b)], dtype=np.uint64)])
        h = (up_to[core:] - up_to[:-core]) * _DOWN[: len(b) - core + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def least_in(values: np.ndarray, places: int) -> np.ndarray:
    """The least of each `places` values in a row: of the running least from block starts and that from block ends."""
    n = len(values) - places + 1
    padded = np.concatenate([values, np.full(-len(values) % places, np.uint64(2**64 - 1))]).reshape(-1, places)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[places - 1 : places - 1 + n])


def packed(start, n, ahead):
    """A run as a long: its first start, how many windows, how far its anchor lies from the first start."""
    return start << 24 | n << 12 | ahead


def unpacked(run):
    return run >> 24, run >> 12 & 4095, run & 4095


def runs_of(raw: bytes | memoryview, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's hash, run's hash, packed run) of a text, in order; none if it is shorter than length."""
    core, places = core_of(length)
    whole, found = np.frombuffer(raw, np.uint8), []
    for first in range(0, len(whole) - length + 1, BLOCK):
        b = whole[first : first + BLOCK + length - 1]
        h = hashes(b, core)
        low = np.uint64(2**32 - 1)
        at = (least_in(h & ~low | np.arange(len(h), dtype=np.uint64), places) & low).astype(np.int64)  # of equal hashes the first
        starts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        n = np.diff(np.concatenate([starts, [len(at)]]))
        view = memoryview(b)
        kinds = np.array([xxhash.xxh3_64_intdigest(view[s : s + k + length - 1]) for s, k in zip(starts.tolist(), n.tolist(), strict=True)], np.uint64)
        found.append((h[at[starts]].view(np.int64), kinds.view(np.int64), packed(starts + first, n, at[starts] - starts)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def sorted_windows(data: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows of data at start repeat within their group: passes over digits of eight bytes, most significant first.

    A pass sorts only groups that the digit splits; windows that are alone leave.
    """
    width = min(8, length)
    digits = np.lib.stride_tricks.sliding_window_view(data, width)
    order = np.argsort(group, kind="stable")
    at, group = start[order], group[order]
    kept = order
    for depth in [*range(0, length - width, width), length - width]:
        last = np.concatenate([group[1:] != group[:-1], [True]]) if len(group) else np.zeros(0, bool)
        alone = last & np.concatenate([[True], last[:-1]]) if len(group) else last
        if alone.any():
            at, group, kept = at[~alone], group[~alone], kept[~alone]
        if not len(at):
            break
        digit = digits[at + depth].copy()
        digit = digit.view(">u8").reshape(-1).astype(np.uint64) if width == 8 else np.ascontiguousarray(digit).view(f"S{width}").reshape(-1)
        new = group[1:] != group[:-1]
        differs = (digit[1:] != digit[:-1]) & ~new
        if differs.any():
            number = np.concatenate([[0], np.cumsum(new)])
            split = np.zeros(number[-1] + 1, bool)
            split[number[1:][differs]] = True
            some = np.flatnonzero(split[number])
            by = np.lexsort((digit[some], number[some]))
            at[some], kept[some], digit[some] = at[some][by], kept[some][by], digit[some][by]
            group = np.concatenate([[0], np.cumsum(new | (digit[1:] != digit[:-1]))])
    repeats = np.zeros(len(start), bool)
    if len(group):
        last = np.concatenate([group[1:] != group[:-1], [True]])
        repeats[kept[~(last & np.concatenate([[True], last[:-1]]))]] = True
    return repeats


RUN = "doc long, hash long, anchor long, kind long, run long"


def keyed(docs: DataFrame) -> DataFrame:
    """doc, hash (what a row is known by: doc_id, 0 for null, and a hash of its text), doc_id, raw (the text's bytes)."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(0).cast("long")).alias("doc"), F.xxhash64(raw).alias("hash"), doc_id.alias("doc_id"), raw.alias("raw"))


def runs(rows: DataFrame, length: int) -> DataFrame:
    """RUN: every run of every text, with its anchor, its kind and its packed place."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(RUN)
    arrow = to_arrow_schema(schema)

    def step(batches):
        for part in parts_of(batches):
            found = [runs_of(x.as_buffer(), length) for x in part.column(2)]
            each = np.repeat(np.arange(part.num_rows), [len(x[0]) for x in found])
            if len(each):
                doc, own = (part.column(k).to_numpy(zero_copy_only=False)[each] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, own, *(np.concatenate(c) for c in zip(*found, strict=True)))], schema=arrow)

    return rows.where(F.length("raw") >= length).select("doc", "hash", "raw").mapInArrow(step, schema)


def with_bytes(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted (doc, hash, anchor, kinds, run, single) with the bytes of each run; a text meets its own runs only."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string("doc long, hash long, anchor long, kinds long, run long, single boolean, bytes binary")
    arrow = to_arrow_schema(schema)
    lists = wanted.groupBy("doc", "hash").agg(F.collect_list(F.struct("anchor", "kinds", "run", "single")).alias("own"))

    def step(batches):
        for part in parts_of(batches):
            own = part.column(3)
            flat, n = own.flatten(), np.diff(own.offsets.to_numpy())
            each = np.repeat(np.arange(part.num_rows), n)
            anchor, kinds, run, single = flat.flatten()
            start, count, _ = unpacked(run.to_numpy())
            texts = [memoryview(x.as_buffer()) for x in part.column(2)]
            cut = [texts[i][s : s + c + length - 1] for i, s, c in zip(each.tolist(), start.tolist(), count.tolist(), strict=True)]
            doc, own_hash = (part.column(k).to_numpy(zero_copy_only=False)[each] for k in (0, 1))
            for at in range(0, len(cut), 4096):
                piece = slice(at, at + 4096)
                yield pa.RecordBatch.from_arrays([pa.array(doc[piece]), pa.array(own_hash[piece]), *(x.slice(at, 4096) for x in (anchor, kinds, run, single)), pa.array([bytes(x) for x in cut[piece]], pa.binary())], schema=arrow)

    found = rows.select("doc", "hash", "raw").join(lists, ["doc", "hash"]).select("doc", "hash", "raw", "own")
    return found.mapInArrow(step, schema)


def sort_small(held: DataFrame, length: int) -> DataFrame:
    """doc, hash, run (packed) of repeated windows in runs of kinds that are there once; a task sorts whole anchors, block by block."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string("doc long, hash long, run long")
    arrow = to_arrow_schema(schema)
    _, places = core_of(length)

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        doc, own, anchor, run = (t.column(k).to_numpy() for k in range(4))
        single = t.column(4).to_numpy(zero_copy_only=False).astype(bool)
        raw = t.column(5).to_pylist()
        data = np.frombuffer(b"".join(raw), np.uint8)
        base = np.concatenate([[0], np.cumsum([len(x) for x in raw])])[:-1]
        first, n, ahead = unpacked(run)
        each = np.repeat(np.arange(len(run)), n)
        within = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        number = np.unique(anchor, return_inverse=True)[1]
        repeats = sorted_windows(data, base[each] + within, number[each] * places + (ahead[each] - within), length) & single[each]
        edge = np.diff(np.concatenate([[False], repeats, [False]]).astype(np.int8))
        cuts = np.concatenate([[True], each[1:] != each[:-1]]) if len(each) else np.zeros(0, bool)
        opens = repeats & ((edge[:-1] == 1) | cuts)
        closes = repeats & ((edge[1:] == -1) | np.concatenate([cuts[1:], [True]]))
        a, z = np.flatnonzero(opens), np.flatnonzero(closes)
        return pa.RecordBatch.from_arrays([pa.array(doc[each[a]]), pa.array(own[each[a]]), pa.array(packed(first[each[a]] + within[a], z - a + 1, 0))], schema=arrow)

    def step(batches):
        held, size, before = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column(2).to_numpy()
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1, [len(anchor)]])
            for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if anchor[a] != before and size >= SORTED_BYTES:
                    yield block(held)
                    held, size = [], 0
                before = anchor[a]
                piece = batch.slice(a, z - a)
                held.append(piece)
                size += piece.nbytes
        if held:
            yield block(held)

    dealt = held.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.select("doc", "hash", "anchor", "run", "single", "bytes").mapInArrow(step, schema)


def count_large(held: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """As sort_small(), for anchors with too many kinds for a task: a row a window, dealt by its digest. And a table to drop later."""
    first, n, ahead = F.shiftright("run", 24), F.shiftright("run", 12).bitwiseAND(4095), F.col("run").bitwiseAND(4095)
    windows = held.select("doc", "hash", "single", "bytes", first.alias("first"), ahead.alias("ahead"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("within"))
    digest = F.sha2(F.substring("bytes", F.col("within").cast("int") + 1, F.lit(length)), 256).alias("window")
    windows = windows.select("doc", "hash", "single", (F.col("first") + F.col("within")).alias("start"), digest)
    repeated = table(windows.groupBy("window").agg(F.count("*").alias("times")).where("times > 1").select("window"))
    alive = windows.where("single").join(repeated, "window", "left_semi")
    return alive.select("doc", "hash", F.shiftleft("start", 24).bitwiseOR(F.lit(1 << 12)).alias("run")), repeated


def repeated_runs(rows: DataFrame, length: int, kinds: int = KINDS) -> DataFrame:
    """doc, hash, own array<long>: the packed runs of repeated windows of each text that has any.

    What is counted is a table before it is joined, so that both sides of a join come straight from a shuffle: only then are hot
    anchors, kinds and windows split among tasks.
    """
    every = runs(rows, length)
    together = table(every.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"))
    alive = table(every.join(together, "anchor", "left_semi"))
    place = F.struct("doc", "hash", "run")
    each_kind = table(alive.groupBy("anchor", "kind").agg(F.count("*").alias("times"), F.min(place).alias("place")))
    resolved = alive.join(each_kind.where("times > 1").select("anchor", "kind"), ["anchor", "kind"], "left_semi").select("doc", "hash", "run")
    single = F.col("times") == 1
    contested = table(each_kind.groupBy("anchor").agg(F.count("*").alias("kinds"), F.count_if(single).alias("singles")).where("kinds > 1 AND singles > 0").select("anchor", "kinds"))
    wanted = each_kind.join(contested, "anchor").select("place.*", "anchor", "kinds", single.alias("single"))
    held = table(with_bytes(rows, wanted, length))
    sorted_out = sort_small(held.where(F.col("kinds") <= kinds), length)
    counted, repeated = count_large(held.where(F.col("kinds") > kinds), length)
    found = resolved.unionByName(sorted_out).unionByName(counted)
    result = table(found.groupBy("doc", "hash").agg(F.collect_list("run").alias("own")))
    drop_tables(together, alive, each_kind, contested, held, repeated)
    return result


def covered(own: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of bytes that packed runs cover."""
    start, n, _ = unpacked(np.sort(own))
    end = np.maximum.accumulate(start + n + length - 1)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])]


REST = "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary"


def remove_repeated(docs: DataFrame, length: int = LENGTH, kinds: int = KINDS) -> DataFrame:
    """doc_id, n_bytes, removed, kept: every text as UTF-8 without the bytes that a repeated window covers.

    A window (length bytes) is repeated if the same string starts anywhere else, in another row or the same one, overlapping
    or not; all copies go, as judged on the input. removed: maximal stretches as [start, end) in bytes, in order; kept: the other
    bytes, joined (it needn't be valid UTF-8).

    Null texts count as empty; texts shorter than length stay whole. Repeated rows are copies of one another: whatever is as
    long as a window goes from all of them. A null doc_id is one like any other. A very long text is read in blocks of BLOCK
    windows, whose borders change nothing. An empty table gives an empty one. Columns other than doc_id and text are not read.

    Texts are shuffled twice, to meet runs whose bytes are asked for and to meet what is to be removed; other rows are of some
    dozen bytes. Hot anchors, kinds and windows are counted before they are shuffled, and joins with them can be split. One table,
    of the runs to remove, stays in the shared folder, as the result reads it.
    """
    ship(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    if not 1 < length <= 4096:
        raise ValueError("a window has 2 to 4096 bytes")
    rows = keyed(docs)
    found = repeated_runs(rows, length, kinds)
    schema = T._parse_datatype_string(REST)
    arrow = to_arrow_schema(schema)

    def step(batches):
        for part in parts_of(batches):
            raw, own = part.column(1), part.column(2)
            flat, offsets = own.flatten().to_numpy(zero_copy_only=False), own.offsets.to_numpy()
            base, sizes, removed, kept = offsets[0], [], [], []
            for i in range(part.num_rows):
                text = memoryview(raw[i].as_buffer())
                mine = flat[offsets[i] - base : offsets[i + 1] - base]
                sizes.append(len(text))
                starts, ends = (x.tolist() for x in covered(mine, length)) if len(mine) else ([], [])
                removed.append([{"start": a, "end": z} for a, z in zip(starts, ends, strict=True)])
                kept.append(b"".join(text[a:z] for a, z in zip([0, *ends], [*starts, len(text)], strict=True)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, arrow.field(2).type), pa.array(kept, pa.binary())], schema=arrow)

    joined = rows.join(found, ["doc", "hash"], "left").select("doc_id", "raw", F.coalesce("own", F.array().cast("array<long>")).alias("own"))
    return joined.mapInArrow(step, schema)


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of remove_repeated()."""
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x.end - x.start)
    return remove_repeated(docs).select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
