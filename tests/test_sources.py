"""Recorded sources, caching, uploads, streams and the stage runner."""

import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkfolio import streaming
from sparkfolio.plans.pipeline import Plugins, Runner, Stage, markdown, validate
from sparkfolio.sources import providers


def test_recorded_answers(spark, tmp_path):
    (tmp_path / "s2.json").write_text(json.dumps({"data": [{"paperId": "p", "title": "T", "year": 2020, "url": "u", "citationCount": 3, "authors": [{"name": "A"}, {"name": None}], "externalIds": {"DOI": "10.1/x", "ArXiv": "17.1"}}]}))
    r = providers.semantic_scholar(spark, str(tmp_path / "s2.json")).first()
    assert (r.title, r.doi, r.authors, r.external_ids) == ("T", "10.1/x", ["A"], {"semantic_scholar": "p", "arxiv": "17.1"})
    (tmp_path / "oa.json").write_text(json.dumps({"results": [{"id": "W1", "title": "T", "publication_year": 2021, "doi": "https://doi.org/10.2/y", "cited_by_count": 5, "abstract_inverted_index": {"hello": [0], "world": [1]}, "authorships": [{"author": {"display_name": "B"}}], "primary_location": {"source": {"display_name": "J"}}}]}))
    r = providers.openalex(spark, str(tmp_path / "oa.json")).first()
    assert (r.abstract, r.doi, r.venue, r.url, r.citations) == ("hello world", "10.2/y", "J", "W1", 5)
    (tmp_path / "feed.xml").write_text("<feed><entry><id>http://arxiv.org/abs/17.1v2</id><title>A\n  title</title><summary>s</summary><published>2017-06-12T17:57:34Z</published><author><name>C</name></author><author><name>D</name></author></entry></feed>")
    r = providers.arxiv(spark, str(tmp_path / "feed.xml")).first()
    assert (r.title, r.year, r.authors, r.external_ids["arxiv"]) == ("A title", 2017, ["C", "D"], "17.1v2")
    registry = providers.Registry()
    registry.register("s2", lambda s, q, n: providers.semantic_scholar(s, str(tmp_path / "s2.json"), n))
    registry.register("down", lambda s, q, n: 1 / 0)
    found, errors = registry.search(spark, ["s2", "down", "unknown"], "q", 5)
    assert found.count() == 1 and set(errors) == {"down", "unknown"}


def test_limits_are_of_each_feed(spark, tmp_path):
    for k in range(3):
        entries = "".join(f"<entry><id>http://arxiv.org/abs/{k}.{i}</id><title>T{i}</title><author><name>A</name></author></entry>" for i in range(6))
        (tmp_path / f"{k}.xml").write_text(f'<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>x</title>{entries}</feed>')
    got = providers.arxiv(spark, str(tmp_path), 2).collect()
    assert sorted(r.external_ids["arxiv"] for r in got) == [f"{k}.{i}" for k in range(3) for i in range(2)]


def test_providers_are_asked_at_once_and_once(spark):
    import threading

    met, calls = threading.Barrier(3, timeout=60), []

    def provider(name):
        def ask(s, q, n):
            calls.append(name)
            met.wait()  # all three have to be there together
            return s.createDataFrame([(name, None, ["A"], 2020, None, None, None, 1, {}, name)], providers.SCHEMA)

        return ask

    registry = providers.Registry()
    for name in "abc":
        registry.register(name, provider(name))
    found, errors = registry.search(spark, list("abc"), "q", 5)
    assert sorted(r.title for r in found.collect()) == list("abc") and found.count() == 3 and sorted(calls) == list("abc") and errors == {}


def test_answers_as_a_stream(spark, tmp_path):
    """Stopped and started again from its checkpoint: nothing is read twice, and what can't be read is a row."""
    from sparkfolio.sources import datasource

    datasource.register(spark)
    folder, out, mark = (tmp_path / x for x in ("in", "out", "mark"))
    folder.mkdir()
    answer = lambda *titles: json.dumps({"data": [{"paperId": t, "title": t} for t in titles]})

    def run():
        source = spark.readStream.format("papers").option("provider", "semantic_scholar").option("errors", "rows").load(str(folder))
        q = source.writeStream.format("parquet").option("checkpointLocation", str(mark)).start(str(out))
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted((r.title, r.error is not None) for r in spark.read.schema(source.schema).parquet(str(out)).select("title", "error").na.fill("-", ["title"]).collect())

    (folder / "b.json").write_text(answer("one", "two"))
    assert run() == [("one", False), ("two", False)]
    time.sleep(0.05)
    (folder / "a.json").write_text(answer("three"))
    (folder / "c.json").write_text("not json")
    assert run() == [("-", True), ("one", False), ("three", False), ("two", False)]
    assert run() == [("-", True), ("one", False), ("three", False), ("two", False)]
    read = spark.read.format("papers").option("provider", "semantic_scholar").option("errors", "rows").load(str(folder))
    assert read.where("error is not null").select("file").first().file.endswith("c.json") and read.count() == 4


def test_cache_and_uploads(spark, tmp_path):
    calls = []

    def provider(s, q, n):
        calls.append(q)
        return s.createDataFrame([("T", None, ["A"], 2020, None, None, None, 1, {"x": "1"}, "p")], providers.SCHEMA)

    cached = providers.Cached("p", provider, str(tmp_path / "cache"))
    assert [cached(spark, "q", 3).count() for _ in range(3)] == [1, 1, 1] and calls == ["q"]
    (tmp_path / "up").mkdir()
    for name, size in (("a.pdf", 10), ("b.exe", 10), ("c.pdf", 0), ("d.PDF", 999)):
        (tmp_path / "up" / name).write_bytes(b"x" * size)
    got = {r.path[-5:]: r.reason for r in providers.uploads(spark, str(tmp_path / "up"), ["pdf"], 500).collect()}
    assert got == {"a.pdf": None, "b.exe": "extension", "d.PDF": "too large"} | ({"c.pdf": "empty"} if "c.pdf" in got else {})


def test_sliding_log():
    pdf = pd.DataFrame({"ts": pd.to_datetime([0, 10, 20, 59, 61, 62], unit="s")})
    assert streaming.sliding_log(pdf, [], 3, 60)[0].tolist() == [True, True, True, False, True, False]


def run_stream(stream, spark, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(once=True).start()
    assert q.awaitTermination(120)
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    rows = [(i, f"u{i % 2}", f"2024-01-01 00:{i:02d}:00", "view", 1.0) for i in range(30)] + [(99, "u0", "2024-01-02 00:00:00", "view", 1.0)]
    events = spark.createDataFrame(rows, "id long, key string, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    windows = run_stream(streaming.windowed_stream(source, "10 minutes", "1 minute"), spark, "windows", "complete")
    assert sorted(r.events for r in windows) == [1, 10, 10, 10]
    sliding = run_stream(streaming.sliding_limit_stream(source, 3, 600.0), spark, "sliding", "append")
    batch = streaming.sliding_limit(events, 3, 600.0).collect()
    assert sorted((r.id, r.allowed) for r in sliding) == sorted((r.id, r.allowed) for r in batch) and not all(r.allowed for r in batch)
    q = streaming.append_batches(source, str(tmp_path / "out"), str(tmp_path / "cp"), "id").trigger(availableNow=True).start()
    assert q.awaitTermination(120) and spark.read.parquet(str(tmp_path / "out")).count() == 31


def test_runner(spark):
    tries, pauses = [], []

    def flaky(context):
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("not yet")
        return {"b": context["a"].where("id > 0")}

    stages = [Stage("one", lambda c: {"a": spark.range(3)}, produces={"a"}), Stage("two", flaky, {"a"}, {"b"}), Stage("bad", lambda c: 1 / 0, optional=True)]
    runner = Runner(stages, retries=2, pause=1, sleep=pauses.append)
    result, context = runner.run()
    assert result == "partial" and context["b"].count() == 2 and pauses == [1, 2, 1, 2]
    assert [(r.stage, r.attempt, r.status) for r in runner.record(spark).collect()][1:4] == [("two", 1, "failed"), ("two", 2, "failed"), ("two", 3, "completed")]
    assert validate([Stage("x", lambda c: {}, {"missing"})]) and time
    with pytest.raises(ValueError):
        Runner([Stage("x", lambda c: {}, {"missing"})])
    plugins = Plugins()
    plugins.register("ok", lambda: 1)
    plugins.register("no", lambda: 1 / 0)
    done, errors = plugins.run()
    assert done == {"ok": 1} and "no" in errors
    assert "| id |" in markdown("R", {"t": spark.range(2), "empty": spark.range(0)}) and "empty" not in markdown("R", {"empty": spark.range(0)})
