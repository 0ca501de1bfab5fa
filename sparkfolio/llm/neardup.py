"""Near duplicates: MinHash signatures joined within a Hamming distance by a multi-index, links confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import cut, map_rows, ship, table, unused

#: Components of a signature, of 16 bits each.
SIZE = 48
#: Chance, at the similarity asked for, that two signatures differ in more components than are searched.
MISS = 1e-4
#: Wrong components that a chunk of the signature may have.
ERRORS = 1
#: A bucket is compared in tiles of blocks of about so many classes and bytes of shingle sets.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
_rng = np.random.default_rng(20240229)
MULTIPLY = (_rng.integers(0, 1 << 31, SIZE, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
ADD = _rng.integers(0, 1 << 32, SIZE, dtype=np.uint32)
FACTORS = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def threshold(similarity: float) -> int:
    """The least signature distance beyond which a pair of this similarity lies with a chance of at most MISS."""
    p = 1 - similarity
    upto = 0.0
    for d in range(SIZE + 1):
        upto += comb(SIZE, d) * p**d * (1 - p) ** (SIZE - d)
        if 1 - upto <= MISS:
            return d
    return SIZE


def chunks(distance: int) -> list[range]:
    """The signature's components in the fewest chunks of which, by the pigeonhole principle, one has at most ERRORS wrong ones."""
    n = distance // (ERRORS + 1) + 1
    cuts = [round(k * SIZE / n) for k in range(n + 1)]
    return [range(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def slots(distance: int) -> list[tuple[int, int, list[int]]]:
    """(chunk, component left out, components that must be equal): all ways for a chunk to have at most ERRORS wrong components."""
    return [(k, out, [c for c in part if c != out]) for k, part in enumerate(chunks(distance)) for out in part]


class Shingler:
    """Sets of hashed shingles of whole texts: words are what ASCII white space separates, A-Z in lower case."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes; of fewer words than a shingle has, one for the whole sequence; none without words."""
        parts = text.encode("utf-8", "surrogatepass").lower().split()
        known = self.known
        if len(known) > 100_000:
            known.clear()
        for w in parts:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array([known[w] for w in parts], np.uint64)
        n = min(self.words, len(h))
        if not n:
            return h
        total = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            total += h[k : len(h) - n + 1 + k] * FACTORS[k]
        total ^= total >> np.uint64(31)
        total *= np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
        return np.unique(total)


def signature(shingles: np.ndarray) -> bytes:
    """SIZE minima of permuted hashes, each reduced to 16 bits."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SIZE, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 8192):
        least = np.minimum(least, (x[None, at : at + 8192] * MULTIPLY[:, None] + ADD[:, None]).min(axis=1))
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2").tobytes()


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, digest, sig for every row; digest and sig are null without shingles."""

    def make():
        shingle = Shingler(words)

        def step(cols):
            sets = [shingle(x or "") for x in cols[1]]
            return [cols[0], [len(s) for s in sets], [digest(s) if len(s) else None for s in sets], [signature(s) if len(s) else None for s in sets]]

        return step

    return map_rows(docs, make, "doc_id long, n_shingles long, digest binary, sig binary")


@lru_cache
def needed(distance: int) -> np.ndarray:
    """SIZE x slots: 1 where a slot asks for a component."""
    out = np.zeros((SIZE, len(slots(distance))), np.int32)
    for s, (_, _, same) in enumerate(slots(distance)):
        out[same, s] = 1
    return out


class Tile:
    """Classes that are compared with one another, or those of side 0 with those of side 1: the rows of a bucket's two blocks.

    Pairs of one label are connected already and pass by. With slot >= 0 a pair counts only where slot is the first that it
    shares, so that it is looked at in one bucket of all those in which it meets.
    """

    def __init__(self, rows: pa.Table, limit: int, percent: int):
        sizes = rows.column("n_shingles").to_numpy()
        self.rows = rows = rows.take(pa.array(np.argsort(sizes, kind="stable")))
        self.ids, self.labels, self.side, self.sizes = (rows.column(c).to_numpy() for c in ("id", "label", "side", "n_shingles"))
        self.sigs = np.frombuffer(b"".join(rows.column("sig").to_pylist()), "<u2").reshape(-1, SIZE)
        self.slot, self.limit, self.percent = rows.column("slot")[0].as_py(), limit, percent

    def partners(self) -> Iterator[tuple[int, np.ndarray]]:
        """A row and the rows within the signature distance whose sizes allow the similarity."""
        ids, labels, sigs, sizes = self.ids, self.labels, self.sigs, self.sizes
        two = bool(self.side.any())
        one = np.flatnonzero(self.side) if two else np.arange(len(ids))
        their = sizes[one]
        for i in np.flatnonzero(self.side == 0) if two else range(len(ids)):
            size = int(sizes[i])
            begin = np.searchsorted(their, -(-self.percent * size // 100)) if two else i + 1
            near = one[begin : np.searchsorted(their, 100 * size // self.percent, "right")]
            near = near[(labels[near] != labels[i]) & (ids[near] != ids[i])]
            if len(near):
                near = near[(sigs[near] != sigs[i]).sum(axis=1) <= self.limit]
            if self.slot >= 0 and len(near):
                near = near[((sigs[near] != sigs[i]).astype(np.int32) @ needed(self.limit) == 0).argmax(axis=1) == self.slot]
            if len(near):
                yield int(i), near

    def met(self) -> pa.Table:
        """The rows that have a partner."""
        found = np.zeros(len(self.ids), bool)
        for i, near in self.partners():
            found[i] = True
            found[near] = True
        return self.rows.filter(pa.array(found))

    def links(self) -> list[tuple[int, int]]:
        """A forest of the links, confirmed on full sets; a row is compared with all partners that it isn't connected with at a time."""
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        sets = [np.frombuffer(b, np.uint64) for b in self.rows.column("shingles").to_pylist()]
        labels, ids, out = self.labels.tolist(), self.ids.tolist(), []
        for i, near in self.partners():
            mine = top(labels[i])
            near = [j for j in near.tolist() if top(labels[j]) != mine]
            if not near:
                continue
            own, whole = sets[i], np.concatenate([sets[j] for j in near])
            hit = own[np.minimum(np.searchsorted(own, whole), len(own) - 1)] == whole
            both = np.add.reduceat(hit, np.cumsum([0, *(len(sets[j]) for j in near[:-1])]), dtype=np.int64)
            for j, b in zip(near, both.tolist(), strict=True):
                if 100 * b >= self.percent * (len(own) + len(sets[j]) - b) and top(labels[j]) != top(labels[i]):
                    root[top(labels[j])] = top(labels[i])
                    out.append((ids[i], ids[j]))
        return out


def by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first three columns, a table for each run of equal ones."""
    held, tile = [], None
    for batch in batches:
        if batch.num_rows:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                at = tuple(keys[begin])
                if at != tile and held:
                    yield pa.Table.from_batches(held)
                    held = []
                tile = at
                held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def dealt(tiles: DataFrame) -> DataFrame:
    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.repartition(n, "bucket", "row", "col").sortWithinPartitions("bucket", "row", "col")


def blocks_of(n: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK), F.ceil(8 * shingles / BLOCK_BYTES)).cast("int")


MEMBER = ["id", "label", "side", "slot", "n_shingles", "digest", "sig"]


def tile_links(docs: DataFrame, tiles: DataFrame, words: int, limit: int, percent: int) -> DataFrame:
    """u, v: a forest of the links of each tile (bucket, row, col and MEMBER), confirmed on full sets.

    Signatures are compared first, on rows of about 150 bytes; only rows with a partner within the distance get their sets,
    made anew of the texts. These are dealt by doc_id, hashed against the few that are asked for: the same plan at every
    size, since what is asked for grows with the input and can't be broadcast. A pair is never a row.
    """

    def meet(batches):
        for rows in by_tile(batches):
            if rows.num_rows > 1 and (met := Tile(rows, limit, percent).met()).num_rows:
                yield from met.combine_chunks().to_batches()

    def compare(batches):
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        for rows in by_tile(batches):
            if rows.num_rows > 1 and (out := Tile(rows, limit, percent).links()):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    def make():
        shingle = Shingler(words)

        def step(cols):
            made = [(i, d, s.tobytes()) for i, x, d in zip(*cols, strict=True) if digest(s := shingle(x or "")) == d]
            return [[m[k] for m in made] for k in range(3)]

        return step

    near = table(dealt(tiles.select("bucket", "row", "col", *MEMBER)).mapInArrow(meet, tiles.select("bucket", "row", "col", *MEMBER).schema))
    asked = table(near.select(F.col("id").alias("doc_id"), "digest").distinct())
    sets = map_rows(docs.join(asked.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "digest"), make, "id long, digest binary, shingles binary")
    whole = near.join(sets.dropDuplicates(["id", "digest"]), ["id", "digest"]).select("bucket", "row", "col", *MEMBER, "shingles")
    return dealt(whole).mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: groups linked by shingle sets of a Jaccard similarity of percent / 100 or more.

    Rows of equal sets are one class, which its smallest doc_id stands for; only classes are compared. A bucket is a chunk of
    the signature with one component left out; two signatures within the distance are guaranteed to share one. First each
    bucket's classes meet its smallest one, which joins groups of copies in work linear in their size. Then the classes of
    a bucket that aren't connected yet meet one another, a pair in the first bucket that it shares: buckets whose classes are
    all connected are passed over. Links are confirmed on full sets. A pair at exactly the similarity lies beyond the distance,
    and may be lost, with a chance of at most MISS; at 0.05 above it with a thousandth of that.

    A text without words (or null) is alone, also beside others. A null doc_id is a member of its class, with a null component
    and kept only if the class has no other id. Rows of the same doc_id are one document. An empty table gives an empty one;
    a very long text is a set like any other; other columns of docs are not read, whatever they are called.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    limit = threshold(percent / 100)
    slim = table(signed(docs, words))
    reps = table(slim.where("digest is not null").groupBy("digest", "sig", "n_shingles").agg(F.min("doc_id").alias("id")).where("id is not null"))

    keys = [F.struct(F.lit(s).alias("slot"), F.xxhash64(F.lit(s), *[F.substring("sig", 2 * c + 1, 2) for c in same]).alias("key")) for s, (_, _, same) in enumerate(slots(limit))]
    entries = reps.select("id", "n_shingles", F.explode(F.array(*keys)).alias("k")).select("id", "n_shingles", "k.slot", "k.key")
    hubs = cut(entries.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where("n > 1").select("key", "hub"))
    several = table(entries.join(hubs, "key"))  # classes in buckets with others
    classes = reps.select("id", "n_shingles", "digest", "sig")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")

    stars = cut(several.where("id <> hub").select("hub", "id", "n_shingles").distinct())
    blocks = table(stars.groupBy("hub").agg(blocks_of(F.count("*"), F.sum("n_shingles")).alias("blocks")))
    rays = stars.join(blocks, "hub").select(F.col("hub").alias("bucket"), own.alias("row"), "id", F.lit(1).alias("side"))
    centres = blocks.select(F.col("hub").alias("bucket"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("row"), F.col("hub").alias("id"), F.lit(0).alias("side"))
    starred = rays.unionByName(centres).withColumns({"col": F.lit(0), "label": F.col("id"), "slot": F.lit(-1)}).join(classes, "id")
    first = components(tile_links(docs, starred, words, limit, percent))

    label = F.coalesce("v", "id").alias("label")
    named = table(several.join(first, F.col("id") == F.col("u"), "left").select("key", "slot", "id", "n_shingles", label))
    split = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), blocks_of(F.count("*"), F.sum("n_shingles")).alias("blocks")).where("low < high").select("key", "blocks")
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("row"), F.greatest(own, j).alias("col"), (own > j).cast("int").alias("side")))
    members = named.join(table(split), "key").select(F.col("key").alias("bucket"), "slot", "id", "label", F.explode(tiles).alias("t")).select("bucket", "t.row", "t.col", "t.side", "slot", "id", "label")
    final = components(first.unionByName(tile_links(docs, members.join(classes, "id"), words, limit, percent)))

    named = reps.join(final.select(F.col("u").alias("id"), "v"), "id", "left").select("digest", F.coalesce("v", "id").alias("component_id"))
    full = slim.where("digest is not null").join(named, "digest", "left").select("doc_id", "n_shingles", "component_id")
    alone = slim.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, of which near_duplicates() keeps the document.

    Rows without doc_id or without words stay; repeated rows of a kept document stay all. The ids that go grow with the input, so
    rows are dealt by doc_id to meet them.
    """
    name = unused(docs, "_gone")
    gone = table(near_duplicates(docs, words, percent).where("not kept and doc_id is not null").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col(name), "left_anti")
