"""Prompts, generation, embeddings' versions, caches, jobs, the data source and reports on literal inputs."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import context, embeddings, graph, logs, overview, resolve, retrieval
from sparkfolio.plans.pipeline import Job, Recorder, Runner, Stage, landscape_json, landscape_markdown
from sparkfolio.sources import providers

from .conftest import rows


def test_prompts_with_history_and_evidence(spark):
    q = spark.createDataFrame([(1, "What is missing?", "research_gap_exploration"), (2, "Else?", "evidence_lookup")], "question_id int, text string, intent string")
    s = spark.createDataFrame([(1, "Gap Report", "Research Gaps", "no data", 5.0, 1), (1, "Landscape", "Datasets", "COCO", 9.0, 2)], "question_id int, source string, label string, content string, score double, pos int")
    h = spark.createDataFrame([(1, "User: hi")], "question_id int, history string")
    e = spark.createDataFrame([(1, k, f"claim {k}", ["P", "Q", "R", "S"] if k == 1 else [], 0.5 if k == 1 else 0.0, k == 2) for k in range(1, 20)], "question_id int, position int, claim string, papers array<string>, confidence double, is_inference boolean")
    out = {r.question_id: r for r in context.prompts(q, s, h, e).collect()}
    system = out[1].system
    assert system.index("Evidence Summary") < system.index("## Context") < system.index("Previous Conversation") < system.index("## Question")
    assert "[Landscape / Datasets]\nCOCO\n\n[Gap Report / Research Gaps]\nno data" in system and context.GAPS_ASKED in system
    assert "1. [EVIDENCE] claim 1 — Papers: P, Q, R (confidence: 0.50)\n2. [INFERENCE] claim 2\n" in system and "15. " in system and "16. " not in system
    assert out[1].user == "Previous conversation:\nUser: hi\n\nQuestion: What is missing?" and out[2].user == "Question: Else?"
    assert context.NOTHING in out[2].system and "Previous" not in out[2].system and "Evidence Summary" not in out[2].system


def test_answers_have_defaults(spark):
    raw = ['{"answer": "a", "confidence": 7, "citations": [{"paper_title": "T"}]}', "plain words", None, "[]"]
    out = [(r.answer, r.confidence, [c.paper_title for c in r.citations], r.evidence, r.reasoning) for r in context.answers(spark.createDataFrame([(k, t) for k, t in enumerate(raw)], "k int, raw string"), "raw").orderBy("k").collect()]
    assert out == [("a", 1.0, ["T"], [], ""), ("plain words", 0.5, [], [], ""), ("", 0.5, [], [], ""), ("", 0.5, [], [], "")]


def test_generation_and_embedding_are_injected(spark):
    def client():
        made = []
        return lambda text: made.append(text) or f"{text}!" if text != "bad" else 1 / 0

    df = spark.createDataFrame([("x",), ("bad",), ("y",)], "p string").repartition(2)
    assert rows(context.generated(df, "p", client).select("generated")) == sorted([("x!",), ("y!",), (None,)], key=repr)
    sizes = lambda: lambda texts: [[float(len(texts) <= 2), float(len(t))] for t in texts]
    out = retrieval.embed(spark.createDataFrame([(t,) for t in ("a", "bb", "ccc", None)], "t string").coalesce(1), "t", embedder=sizes, batch=2).collect()
    assert [(r.t, r.embedding) for r in out] == [("a", [1.0, 1.0]), ("bb", [1.0, 2.0]), ("ccc", [1.0, 3.0]), (None, [1.0, 0.0])]


def test_follow_ups(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "question_id int")
    s = spark.createDataFrame([(1, 1, "Datasets", "- COCO images: many\n[x] ImageNet\nshort"), (1, 2, "Datasets", "* coco IMAGES: again\nImageNet"), (1, 3, "Limitations", "tiny"), (2, 1, "Unknown", "x")], "question_id int, pos int, label string, content string")
    c = spark.createDataFrame([(1, "Methodology and datasets")], "question_id int, claim string")
    out = {}
    for r in context.follow_ups(q, s, c).orderBy("question_id", "position").collect():
        out.setdefault(r.question_id, []).append(r.text)
    assert out[1] == [
        "What datasets are most relevant to COCO images, ImageNet?", "What limitations are used in this research area?", "How do the methodologies compare in these studies?", "Which datasets are most commonly used in these studies?",
        "What are the main research challenges identified?",
    ]
    assert out[2] == out[3] == [x for x, *_ in context.ALWAYS[:3]]


def test_context_is_cut_to_shares(spark):
    a = [(1, "i", "knowledge_package", "ready", 1, "old"), (2, "i", "knowledge_package", "ready", 2, "line\n" * 4000), (3, "i", "research_gap_report", "ready", 1, "g" * 6000), (4, "i", "paper_collection", "draft", 1, "p"), (5, "j", "paper_collection", "ready", 1, "q")]
    df = spark.createDataFrame(a, "id int, investigation_id string, artifact_type string, status string, created_at int, payload string")
    got = {(r.investigation_id, r.artifact_type): len(r.content) for r in context.artifact_context(df).collect()}
    assert got == {("i", "knowledge_package"): 7999, ("i", "research_gap_report"): 5000, ("j", "paper_collection"): 1}
    small = {r.investigation_id: r for r in context.context_text(context.artifact_context(df, total=8100), total=8100).collect()}
    assert small["i"].context.startswith("=== Knowledge Package ===\nline") and small["i"].context.endswith("g" * 101 + "\n" + context.CUT_NOTE) and small["j"].context == "=== Paper Collection ===\nq"


def test_refreshed_embeddings(spark):
    a = spark.createDataFrame([(1, 7, 1, "ready", "old text"), (2, 7, 3, "ready", "new text"), (3, 7, 9, "draft", "x"), (4, 8, 1, "ready", "first")], "id long, investigation_id long, version int, status string, payload string")
    stored = spark.createDataFrame([(7, 1, 0, "old text", [1.0], 2), (7, 2, 0, "stale", [1.0], 1), (7, 2, 1, "stale", [1.0], 1)], "investigation_id long, artifact_id long, chunk_index int, content string, embedding array<float>, artifact_version long")
    after = embeddings.refreshed(a, stored, dimensions=4)
    assert rows(after.select("investigation_id", "artifact_id", "content", "artifact_version")) == [(7, 1, "old text", 2), (7, 2, "new text", 3), (8, 4, "first", 1)]
    new = after.join(stored.select("content"), "content", "left_anti")
    assert rows(embeddings.summary(a, stored, new)) == [(7, 1, 1, 1), (8, 1, 0, 1)]
    assert rows(embeddings.embedded_counts(a, stored)) == [(7, 3, 2), (8, 0, 0)]


def test_cache_expires_and_is_deleted_by_pattern(spark, tmp_path):
    now = [time.time()]
    cache = providers.TableCache(spark, str(tmp_path / "c"), 100, clock=lambda: now[0])
    made = []
    compute = lambda: made.append(1) or spark.range(len(made))
    assert [cache.get_or_compute("search/a:1", compute)[1] for _ in range(2)] == [False, True] and len(made) == 1
    now[0] += 300
    assert cache.get("search/a:1") is None and not cache.exists("search/a:1")
    value, there = cache.get_or_compute("search/a:1", compute)
    assert not there and value.count() == 2
    cache.set("search/b:1", spark.range(1))
    cache.set("other/b", spark.range(1))
    assert cache.delete_pattern("search/*:1") == 2 and cache.delete_pattern("search/*") == 0
    now[0] -= 300
    assert cache.exists("other/b") and cache.delete("other/b") and not cache.exists("other/b")
    with pytest.raises(ValueError):
        cache.get("../x")
    calls = []
    provider = lambda s, q, n: calls.append(q) or s.createDataFrame([("T", None, ["A"], 2020, None, None, None, 1, {"x": "1"}, "p")], providers.SCHEMA)
    cached = providers.Cached("p", provider, str(tmp_path / "d"), 100, clock=lambda: now[0])
    cached(spark, "q", 3).count()
    now[0] += 500
    assert cached(spark, "q", 3).count() == 1 and calls == ["q", "q"]


def test_uploads_by_type(spark):
    files = [("a/x.pdf", 5, None), ("a/x.pdf", 5, "application/x-sh"), ("a/.hidden", 5, "text/plain"), ("a/noext", 5, None), ("a/noext", 5, "text/plain"), ("x.exe", 5, "text/plain"), ("x.txt", 0, None), ("x.txt", 99, " TEXT/plain ")]
    got = [r.reason for r in providers.checked_uploads(spark.createDataFrame(files, "path string, length long, mime_type string").coalesce(1), ["pdf", "txt"], 50).collect()]
    assert got == [None, "type", "name", "type", None, "extension", "empty", "too large"]


def test_papers_data_source(spark, tmp_path):
    from sparkfolio.sources import datasource

    datasource.register(spark)
    (tmp_path / "s2").mkdir()
    for k in range(2):
        (tmp_path / "s2" / f"{k}.json").write_text(json.dumps({"data": [{"paperId": f"p{k}", "title": "T", "year": 2020, "url": "https://x/doi.org/10.1/x", "citationCount": 3, "authors": [{"name": "A"}, {"name": None}], "externalIds": {"ArXiv": "17.1"}}]}))
    read = lambda name: spark.read.format("papers").option("provider", name).load(str(tmp_path / "s2"))
    df = read("semantic_scholar")
    assert df.rdd.getNumPartitions() == 2 and sorted(r.external_ids["semantic_scholar"] for r in df.collect()) == ["p0", "p1"]
    declared = providers.semantic_scholar(spark, str(tmp_path / "s2"))
    assert rows(df) == rows(declared.select(*df.columns))
    (tmp_path / "oa").mkdir()
    (tmp_path / "oa" / "a.json").write_text(json.dumps({"results": [{"id": "W1", "title": "T", "publication_year": 2021, "doi": "https://doi.org/10.2/y", "cited_by_count": 5, "abstract_inverted_index": {"hello": [0], "world": [1, 3]}, "authorships": [{"author": {"display_name": "B"}}], "primary_location": {"source": {"display_name": "J"}}}]}))
    alex = spark.read.format("papers").option("provider", "openalex").load(str(tmp_path / "oa"))
    assert rows(alex) == rows(providers.openalex(spark, str(tmp_path / "oa")).select(*alex.columns)) and alex.first().abstract == "hello world  world"
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "a.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/17.1v2</id><title>A\n  title</title><published>2017-06-12T17:57:34Z</published><author><name>C</name></author></entry></feed>')
    r = spark.read.format("papers").option("provider", "arxiv").load(str(tmp_path / "feed")).first()
    assert (r.title, r.year, r.authors, r.external_ids["arxiv"]) == ("A title", 2017, ["C"], "17.1v2")


def test_runner_times_out_records_and_cancels(spark):
    heard = []

    class Kept(Recorder):
        def started(self, stage, attempt):
            heard.append((stage, attempt, "started"))

        def completed(self, stage, attempt):
            heard.append((stage, attempt, "completed"))

        def failed(self, stage, attempt, error):
            heard.append((stage, attempt, error))

    def slow(context):
        return {"b": spark.createDataFrame(spark.range(10**12).agg(F.max(F.xxhash64("id")).alias("x")).collect())}

    shares = []
    stages = [Stage("one", lambda c: {"a": spark.range(3)}, produces={"a"}), Stage("slow", slow, {"a"}, {"b"})]
    runner = Runner(stages, retries=2, sleep=lambda s: None, seconds=2.0, spark=spark, recorder=Kept())
    result, _ = runner.run(progress=lambda stage, share: shares.append((stage, share)))
    assert result == "failed" and shares == [("one", 0.5)]
    assert heard == [("one", 1, "started"), ("one", 1, "completed"), ("slow", 1, "started"), ("slow", 1, "timed out after 2 s")]  # no second attempt
    runner = Runner([Stage("x", lambda c: runner.cancel() or {}), Stage("y", lambda c: {})], spark=spark)
    assert runner.run()[0] == "cancelled" and [a[0] for a in runner.attempts] == ["x"]


def test_jobs():
    pauses, tries = [], []

    def work(job):
        tries.append(1)
        job.report(0.5, "half")
        if len(tries) < 3:
            raise RuntimeError("no")
        return "done"

    job = Job(work, sleep=pauses.append)
    assert job.run() == "completed" and job.result == "done" and pauses == [5, 10] and (job.share, job.tried) == (1.0, 3)
    assert job.run() == "completed" and len(tries) == 3 and not job.cancel()  # again: nothing happens
    bad = Job(lambda j: 1 / 0, sleep=pauses.append)
    assert bad.run() == "failed" and bad.tried == 4 and pauses[2:] == [5, 10, 20]
    stopped = Job(lambda j: j.cancel() and j.report(0.9))
    assert stopped.run() == "cancelled"


def test_landscape_reports(spark):
    papers = spark.createDataFrame([(1, 2020), (2, 2021), (3, None)], "paper_id int, year int")
    e = [(1, "institution", "MIT"), (1, "institution", "Google"), (2, "institution", "MIT"), (1, "methodology", "CNN"), (2, "methodology", "CNN"), (3, "technology", "JAX"), (1, "technology", "CUDA"), (1, "author", "A"), (1, "author", "B"), (2, "dataset", "COCO")]
    entities = spark.createDataFrame(e, "paper_id int, type string, name string")
    techniques = spark.createDataFrame([(1, "dropout"), (2, "attention"), (2, "dropout")], "paper_id int, name string")
    found = overview.landscape(papers, entities, techniques)
    observed = overview.observations(found)
    text, nested = landscape_markdown(found, observed), landscape_json(found, observed)
    for line in ("| Total Papers | 3 |", "| Years Covered | 2020–2021 |", "| MIT | university | 2 | 2 |", "| CNN | 2 | attention, dropout |", "- **Newest technology:** CUDA (first appeared 2020)", "- **Most Central:** A (centrality 1.00)", "- **Institution collaboration intensity:** 0.5 collaborations per institution", "| Google | MIT | 1 |"):
        assert line in text, line
    assert nested["methodologies"]["top"] == [{"rank": 1, "name": "CNN", "other": "attention|dropout", "value": 2.0, "second": 2.0}] and nested["observations"][0]["value"] == "MIT (2 papers)"
    empty = overview.landscape(papers.limit(0), entities.limit(0), techniques.limit(0))
    assert landscape_markdown(empty, overview.observations(empty)) == "# Research Landscape\n"


def test_repeated_events_are_written_once(spark, tmp_path):
    from sparkfolio import streaming

    schema = "id long, ts timestamp"
    for k, ids in enumerate(([1, 2, 2], [2, 3])):
        spark.createDataFrame([(i,) for i in ids], "id long").selectExpr("id", "timestamp'2024-01-01 00:00:00' as ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = streaming.append_batches(source, str(tmp_path / "out"), str(tmp_path / "cp"), "id", late="1 hour").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_small_additions(spark):
    t = spark.createDataFrame([("a", 2.0, True), ("b", 3.0, True), ("c", 9.0, False), ("d", 2.0, True)], "name string, growth double, emerging boolean")
    assert [(r.name, r["rank"]) for r in graph.top_emerging(t, 2).orderBy("rank").collect()] == [("b", 1), ("a", 2)]
    k = spark.createDataFrame([(1, "x"), (2, "y")], "paper_id int, name string")
    meta = spark.createDataFrame([(1, 2020, 5, "V")], "paper_id int, year int, citations int, venue string")
    assert rows(graph.with_paper_meta(k, meta)) == [(1, "x", 2020, "V", 5), (2, "y", None, None, 0)]
    by_url = spark.createDataFrame([(1, "a", None, "u"), (2, "b", None, "u"), (3, "B!", None, None)], "pos long, title string, doi string, url string")
    assert rows(resolve.kept_first(by_url, ("doi", "title", "norm")).select("pos")) == [(1,), (2,)] and rows(resolve.kept_first(by_url).select("pos")) == [(1,), (3,)]
    n = spark.createDataFrame([("a", "b", "x"), ("a", "b", "y")], "title string, content string, source_type string")
    assert logs.searched_notes(n, "", "y").count() == 1 == logs.searched_notes(n, "A", "x").count()
    pairs = spark.createDataFrame([(1, f"n{k:03d}") for k in range(300)], "paper_id int, name string")
    assert graph.pair_counts(pairs).count() == 300 * 299 // 2


def test_python_reaches_workers_without_a_path(tmp_path):
    """A session whose workers don't find the package on any path of theirs."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from sparkfolio.session import checkpoints, session
from sparkfolio.operators import resolve
s = session("local[2]", 2)
checkpoints(s)
p = s.createDataFrame([(k, "t", None, None) for k in range(5)], "pos long, title string, doi string, url string")
assert resolve.greedy_groups(p).where("group = 0").count() == 5
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
