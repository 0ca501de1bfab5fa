"""Order-preserving packing of tokenised documents into windows by dynamic programming."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .prefix_bpe import byte_level
from .runtime import parts_of, ship, text_of

#: Cost of a cut in padding tokens: after a document, after a sentence, elsewhere.
AFTER_DOCUMENT, AFTER_SENTENCE, ELSEWHERE = 0, 2, 10
#: Cost of a window, lest short windows of a power of two are made where long ones do as well.
WINDOW = 6
#: Elsewhere, cuts are looked for at every so many tokens; at each of the last tokens of a stream.
GRID = 32
#: Tokens that are packed at a time; the last window of a block is packed again with the next block.
BLOCK = 1 << 17


def choose_cuts(ends: np.ndarray, costs: np.ndarray, size: int, powers: tuple[int, ...]) -> list[int]:
    """Positions after which windows end, the last of ends included: minimal padding plus cut costs.

    ends: ascending candidate positions (> 0), neighbours at most size apart; costs: of cutting there. A window of n
    tokens pads size - n, and nothing if n is a power of two. best[j] = costs[j] + size - ends[j] + min(best[i] + ends[i])
    over i with ends[j] - ends[i] <= size: the minimum of a sliding window, kept in a monotone queue. Windows of
    the powers of two in powers are looked up beside it. Ties: the earlier start, that is, the longer window.
    """
    n = len(ends)
    at = np.concatenate([[0], ends])
    looked = []
    for p in powers:
        i = np.searchsorted(at, at - p)
        looked.append(np.where((at >= p) & (at[np.minimum(i, n)] == at - p), i, -1).tolist())
    pos, cost = at.tolist(), [0, *costs.tolist()]
    best, prev = [0.0] * (n + 1), [0] * (n + 1)
    # the queue: values ascend from first to last, and so do the positions of their candidates
    values, where, which = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    first = last = 0
    for j in range(1, n + 1):
        here = pos[j]
        least = here - size
        while where[first] < least:
            first += 1
        value, i = values[first] - least, which[first]
        for steps in looked:
            k = steps[j]
            if k >= 0 and best[k] < value:
                value, i = best[k], k
        value += cost[j]
        best[j], prev[j] = value, i
        value += here
        while last >= first and values[last] > value:
            last -= 1
        last += 1
        values[last], where[last], which[last] = value, here, j
    out, j = [], n
    while j:
        out.append(pos[j])
        j = prev[j]
    return out[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, size: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions for choose_cuts() and their costs: ends of documents and sentences, and a grid in between."""
    n = len(ids)
    cost = np.full(n + 1, np.inf, np.float32)
    cost[np.arange(GRID, n + 1, GRID)] = ELSEWHERE
    if last:
        cost[max(1, n - 2 * size) :] = ELSEWHERE
    cost[1:][sentence_end[ids]] = AFTER_SENTENCE
    cost[doc_ends] = AFTER_DOCUMENT
    cost[n] = 0
    ends = np.flatnonzero(cost[1:] < np.inf) + 1
    return ends, cost[ends] + WINDOW


class Packer:
    """Takes documents one by one and gives pieces as windows get filled; finish() gives the rest."""

    def __init__(self, size: int, sentence_end: np.ndarray, first_sequence: int):
        self.size, self.sentence_end, self.sequence = size, sentence_end, first_sequence
        self.docs: list[tuple] = []  # id, ids that are not packed yet, start of these, tokens of the document
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> list[tuple]:
        self.docs.append((doc_id, ids, 0, len(ids)))
        self.held += len(ids)
        return self.pack(False) if self.held >= BLOCK else []

    def finish(self) -> list[tuple]:
        return self.pack(True) if self.docs else []

    def pack(self, last: bool) -> list[tuple]:
        ids = np.concatenate([d[1] for d in self.docs])
        doc_ends = np.cumsum([len(d[1]) for d in self.docs])
        powers = tuple(1 << k for k in range(self.size.bit_length() - 1)) if last else (self.size >> 1,)
        cuts = choose_cuts(*candidates(ids, doc_ends, self.sentence_end, self.size, last), self.size, powers)
        if not last:
            cuts = cuts[:-4] if len(cuts) > 8 else cuts[: len(cuts) // 2]  # the end of the block is no reason to cut
        out, k, begin, used = [], 0, 0, 0
        for end in cuts:
            offset = 0
            while begin < end:
                doc_id, own, start, total = self.docs[k]
                take = min(end - begin, len(own) - used)
                out.append((doc_id, start + used, take, zlib.crc32(own[used : used + take].tobytes()), total, self.sequence, offset))
                offset, begin, used = offset + take, begin + take, used + take
                if used == len(own):
                    k, used = k + 1, 0
            self.sequence += 1
        rest = self.docs[k:]
        if rest and used:
            doc_id, own, start, total = rest[0]
            rest[0] = (doc_id, own[used:], start + used, total)
        self.docs, self.held = rest, self.held - begin
        return out


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 1024, separator: int = 0) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece of a document in a window of at most size tokens.

    Documents keep the order in which a partition holds them, each followed by the id separator; a null or empty text
    has that id only. Repeated rows are documents of their own, as are rows without doc_id; an empty table has no pieces.
    Other columns of docs are not read, whatever they are called. Windows are cut where padding and cut costs are least.
    sequence_id is unique over all partitions (the partition in the upper bits). A partition is packed as a stream in blocks,
    so memory doesn't grow with it but by one text's ids, however long the text; nothing is shuffled, and only a partition's
    last windows may have padding for want of text.
    """
    ship(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    arrow = pa.schema(fields)

    def run(batches):
        bpe = byte_level(tokenizer)
        ends = np.zeros(max(bpe.bytes) + 1, bool)
        for i, raw in bpe.bytes.items():
            ends[i] = b"\n" in raw or raw.rstrip().endswith((b".", b"!", b"?", "。".encode()))
        ends[separator] = True
        packer = Packer(size, ends, TaskContext.get().partitionId() << 40)

        def encode(text: str) -> np.ndarray:
            return np.array([*bpe.merged_ids(text), separator], "<u4")

        def rows(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], schema=arrow)

        for part in parts_of(batches):
            for doc_id, text in zip(part.column(0), part.column(1), strict=True):
                if out := packer.add(doc_id.as_py(), encode(text.as_py() or "")):
                    yield rows(out)
        if out := packer.finish():
            yield rows(out)

    return text_of(docs).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
