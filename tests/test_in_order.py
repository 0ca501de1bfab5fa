"""The sliding limit on a stream that delivers late, repeatedly and out of order, against its batch form."""

import random
from datetime import datetime, timedelta

from sparkfolio import streaming

from .conftest import rows

SCHEMA = "id long, key string, ts timestamp"
START = datetime(2024, 1, 1)


def arrivals(seed):
    """Batches of (id, key, second): times wander, some requests come twice, some far too late; a last one moves the watermark past all."""
    rng = random.Random(seed)
    out, n = [], 0
    for k in range(5):
        batch = []
        for _ in range(40):
            batch.append((n, rng.choice("aab"), k * 60 + rng.randint(-50, 50) - (300 if rng.random() < 0.1 else 0)))
            n += 1
        batch += rng.sample(batch, 5) + (rng.sample(out[-1], 3) if out else [])
        rng.shuffle(batch)
        out.append(batch)
    return [*out, [(n, "z", 10_000)], [(n + 1, "z", 20_000)]]


def test_stream_in_order_is_the_batch_form(spark, tmp_path):
    batches, late, watermark, newest, on_time = arrivals(4), 90, None, None, set()
    for k, batch in enumerate(batches):
        for r in batch:  # what the watermark of earlier batches lets through
            if watermark is None or r[2] > watermark:
                on_time.add(r)
        newest = max([newest or 0, *(r[2] for r in batch)])
        watermark = newest - late
        made = [(i, key, START + timedelta(seconds=s)) for i, key, s in batch]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    assert len(on_time) < len({r for b in batches for r in b})  # some are too late
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for k in range(len(batches)):  # a run a batch from the same checkpoint: restarts keep state and timers
            (tmp_path / "seen").mkdir(exist_ok=True)
            for f in (tmp_path / f"in/part={k}").glob("part-*.parquet"):
                f.rename(tmp_path / "seen" / f"{k}-{f.name}")
            stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "seen"))
            out = streaming.sliding_limit_in_order(stream, 3, 20.0, f"{late} seconds")
            q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    source = spark.createDataFrame([(i, key, START + timedelta(seconds=s)) for i, key, s in sorted(on_time) if key != "z"], SCHEMA)
    got = spark.read.parquet(str(tmp_path / "out")).where("key <> 'z'")
    assert rows(got) == rows(streaming.sliding_limit(source, 3, 20.0))
    assert {r[3] for r in rows(got)} == {True, False}
