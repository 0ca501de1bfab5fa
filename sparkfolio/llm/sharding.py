"""Best-fit-decreasing packing of indivisible groups of documents into shards."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, table


def best_fit_decreasing(items: list[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """(size, first, count, bin) for items (size, how many of it), sizes descending: each into the fullest bin that it fits in.

    Remaining capacities are kept in order (a balanced search structure), so the tightest bin is found by bisection. Having got
    an item, that bin stays the tightest for the next of its size until it is too full; so items of a size go in runs: its
    items first, first + 1, ... go to the bin. An item that fits nowhere opens a bin, even if it is larger than the capacity.
    None if that takes more than so many bins. Ties go to the bin that was opened first.
    """
    free: list[tuple[int, int]] = []
    placed: list[tuple[int, int, int, int]] = []
    opened = 0
    for size, count in items:
        first = 0
        while first < count:
            i = bisect_left(free, (size, -1))
            if i < len(free):
                left, k = free.pop(i)
            else:
                left, k = capacity, opened
                opened += 1
                if bins is not None and opened > bins:
                    return None
            n = min(count - first, max(1, left // size))
            placed.append((size, first, n, k))
            first += n
            insort(free, (left - n * size, k))
    return placed


def fewest_bytes(items: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """best_fit_decreasing() with the least capacity, found by bisection, for which it needs at most so many bins.

    With the mean and the largest size together it never needs more: an item that fits nowhere would mean that every bin holds
    more than the mean. So the bisection takes as many steps as the largest size has bits.
    """
    if not items:
        return []
    mean, largest = -(-sum(s * n for s, n in items) // bins), max(s for s, _ in items)
    low, high = max(largest, mean), mean + largest
    while low < high:
        mid = (low + high) // 2
        if best_fit_decreasing(items, mid, bins) is not None:
            high = mid
        else:
            low = mid + 1
    return best_fit_decreasing(items, low, bins)


def ranked(df: DataFrame, by: str, order: list[str], part: str) -> DataFrame:
    """df with rank (long, from 0) within by, in the order of part, then of order: a group is ranked in as many tasks as it has parts."""
    counts = df.groupBy(by, part).agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = table(counts.select(F.col(by).alias("_by"), F.col(part).alias("_part"), F.coalesce(earlier, F.lit(0)).alias("_before")))
    own = F.row_number().over(Window.partitionBy(by, part).orderBy(*order)) - 1
    joined = df.withColumn("_own", own).join(starts, (F.col(by) == F.col("_by")) & (F.col(part) == F.col("_part")))
    return joined.withColumn("rank", (F.col("_before") + F.col("_own")).cast("long")).drop("_own", "_by", "_part", "_before")


def shard_documents(docs: DataFrame, shards: int = 24, parts: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: documents in shards of near equal bytes; equal texts stay together.

    size: UTF-8 bytes plus 8; a null text has none and is grouped with empty texts. Every group of equal texts is an item of
    best fit decreasing, of the sum of its sizes. Items of one size are alike, so the driver places how many there are of
    each size (at most as many rows as the root of twice all bytes, since distinct sizes add up to no more), and an item's
    bin follows from its rank among those of its size. law is "bytes"; grown_shard is null. slot numbers a shard's rows from 0
    without gaps, in an order by hashes of doc_id, then doc_id; repeated rows are interchangeable, rows without doc_id too.
    Texts, however long, are read once and never shuffled; other columns are not read. An empty table gives an empty one. A
    group above a 24th of all bytes makes its shard larger: it is indivisible.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    rows = cut(
        docs.select(
            doc_id.alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.xxhash64(text).alias("group"),
            F.pmod(F.xxhash64(doc_id, F.lit("slot")), F.lit(parts)).cast("int").alias("part"),
        )
    )
    spark = docs.sparkSession
    groups = cut(rows.groupBy("group").agg(F.sum("size").alias("total"), F.count("*").alias("copies")).withColumn("deal", F.pmod("group", F.lit(parts)).cast("int")))
    sizes = groups.groupBy("total").agg(F.count("*").alias("n")).toArrow()  # a row for each distinct size
    items = sorted(zip(sizes.column(0).to_pylist(), sizes.column(1).to_pylist(), strict=True), reverse=True)
    runs = fewest_bytes(items, shards)
    columns = [pa.array(c, pa.int64()) for c in (zip(*runs, strict=True) if runs else ([], [], [], []))]
    placed = spark.createDataFrame(pa.table(columns, names=["_size", "_first", "_count", "_shard"]))
    of_size = ranked(groups, "total", ["group"], "deal")
    where = of_size.join(placed, (F.col("total") == F.col("_size")) & (F.col("rank") >= F.col("_first")) & (F.col("rank") < F.col("_first") + F.col("_count")))
    where = cut(where.select(F.col("group").alias("_group"), F.col("_shard").cast("int").alias("shard"), "copies"))

    # groups of many copies, of which there are at most shards * parts, are looked up beside the shuffle, not within it
    many = rows.count() // (shards * parts) + 1
    hot = F.broadcast(where.where(F.col("copies") >= many).select(F.col("_group").alias("_hot"), F.col("shard").alias("_of_hot")))
    cold = where.where(F.col("copies") < many).select("_group", F.col("shard").alias("_of_cold"))
    tagged = rows.join(hot, F.col("group") == F.col("_hot"), "left")
    key = F.when(F.col("_hot").isNull(), F.col("group"))
    mine = tagged.where("_hot is null").join(cold, key == F.col("_group")).select("doc_id", "size", "text_crc32", "part", F.col("_of_cold").alias("shard"))
    put = cut(mine.unionByName(tagged.where("_hot is not null").select("doc_id", "size", "text_crc32", "part", F.col("_of_hot").alias("shard"))))
    return ranked(put, "shard", ["doc_id", "text_crc32"], "part").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
