"""Operators on literal inputs with known results."""

import json

import pytest
from pyspark.sql import functions as F

from sparkfolio.functions import aliases, json_repair, text
from sparkfolio.operators import gaps, graph, institutions, landscape, logs, ranking, resolve, retrieval, sinks, validation

from .conftest import rows


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_text_functions(spark):
    assert one(spark, text.normalized_title(F.lit("  Attention: Is   All! You Need "))) == "attention is all you need"
    assert one(spark, text.normalized_url(F.lit("HTTPS://Example.org/a//"))) == "example.org/a"
    assert one(spark, text.normalized_url(F.lit(""))) is None
    assert one(spark, text.doi_from_url(F.lit("https://doi.org/10.1/x"))) == "10.1/x"
    assert [one(spark, text.normalized_term(F.lit(x))) for x in ("classes", "deep learning", "evaluations")] == ["class", "deep learn", "evaluat"]
    assert one(spark, text.normalized_author(F.lit("Doe,  Jane"))) == "Jane Doe"
    assert one(spark, text.abstract_from_index(F.expr("map('deep', array(0), 'nets', array(1, 3))"))) == "deep nets  nets"
    assert one(spark, text.content_overlap(F.lit("deep learning is used"), F.lit("deep learning is the main approach"))) > 0.5
    assert one(spark, text.content_overlap(F.lit(""), F.lit("x"))) == 0
    names = ["", " ", "x", "TBD", "123", "---", "BERT"]
    assert [one(spark, text.is_entity_name(F.lit(n))) for n in names] == [False] * 6 + [True]
    assert one(spark, text.entity_confidence(F.lit("institution"), F.lit("Stanford University"), F.lit(True))) == 1.0
    kinds = {"MIT": "university", "Bell Labs": "lab", "Google": "company", "NASA agency": "government", "Foo": "other"}
    assert {n: one(spark, text.kind_of(F.lit(n), text.INSTITUTION_KINDS)) for n in kinds} == kinds
    assert one(spark, text.kind_of(F.lit("Smith"), text.INSTITUTION_KINDS)) == "university" and one(spark, text.kind_of(F.lit("Smith"), text.INSTITUTION_KINDS, True)) == "other"
    ids = one(spark, text.external_ids(arxiv=F.lit(" 17.1 "), openalex=F.lit("")))
    assert [(i.namespace, i.id) for i in ids] == [("arxiv", "17.1")]


def test_aliases(spark):
    df = spark.createDataFrame([("institution", "  MIT  "), ("institution", "fair"), ("methodology", "rl"), ("dataset", "diffusion"), ("institution", None)], "kind string, name string")
    got = [r.resolved for r in aliases.resolved(df, "kind", "name", aliases.GRAPH).orderBy("kind", F.desc("name")).collect()]
    assert sorted(got, key=str) == sorted(["Massachusetts Institute of Technology", "Meta", "Reinforcement Learning", "diffusion", None], key=str)


def bridge(spark):
    return spark.createDataFrame([("P1", "A"), ("P2", "A"), ("P2", "B"), ("P3", "B"), ("P1", "C")], "paper_id string, name string")


def test_graph(spark):
    assert rows(graph.pair_counts(bridge(spark))) == [("A", "B", 1), ("A", "C", 1)]
    authors = spark.createDataFrame([("P1", "Alice"), ("P1", "Bob"), ("P2", "Alice"), ("P2", "Charlie")], "paper_id string, name string")
    assert [(r.name, r.centrality) for r in graph.weighted_degrees(graph.pair_counts(authors)).orderBy("name").collect()] == [("Alice", 1.0), ("Bob", 0.5), ("Charlie", 0.5)]
    years = spark.createDataFrame([("T", 2022, 1), ("T", 2023, 1), ("T", 2024, 2), ("S", 2022, 3), ("S", 2023, 1), ("U", 2024, 5)], "name string, year int, papers long")
    got = {r.name: (r.first_year, r.growth, r.emerging, r.declining) for r in graph.trends(years, ["name"]).collect()}
    assert got == {"T": (2022, 1.0, True, False), "S": (2022, -2 / 3, False, True), "U": (2024, 0.0, False, False)}
    values = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), ("y", 5)], "g string, v int")
    assert [r.z for r in graph.z_scores(values, "v", ["g"]).orderBy("g", "v").collect()] == [-1, 0, 1, 0]
    p = graph.percentiles(spark.createDataFrame([("g", i) for i in range(1, 6)], "g string, v int"), "v", ["g"], [0, 50, 100]).first()
    assert (p.p0, p.p50, p.p100) == (1, 3, 5)


def papers(spark):
    data = [
        (1, "Deep Nets", "a" * 60, ["X"], 2020, "V", "10.1234/a", "http://h/1", 10, "arxiv"),
        (2, "deep nets!", None, ["X", "Y"], None, "", "10.1234/b", "http://h/2", 0, "openalex"),
        (3, "Other", "short", [], 2050, "V", "10.1234/A", "bad", -1, "other"),
        (4, "", "", None, 1800, None, "x", None, 5, "openalex"),
    ]
    return spark.createDataFrame(data, "pos long, title string, abstract string, authors array<string>, year int, venue string, doi string, url string, citations int, source string")


def test_validation(spark):
    got = {r.pos: (r.issues, r.score, r.status) for r in validation.scored(validation.with_issues(papers(spark), 2025)).collect()}
    assert got[1] == (["duplicate_doi"], 0, "invalid")
    assert got[2] == (["missing_abstract", "missing_venue"], 85, "warning")
    assert got[3] == (["duplicate_doi", "missing_authors", "future_year", "invalid_citation_count", "invalid_url"], 0, "invalid")
    assert got[4][0] == ["empty_title", "missing_abstract", "missing_authors", "missing_venue", "invalid_year", "invalid_doi_format"]
    assert validation.summary(validation.scored(validation.with_issues(papers(spark), 2025))).first().asDict() == {"total": 4, "valid": 0, "warning": 1, "invalid": 3, "duplicates": 2, "average_score": 21.3}
    assert validation.summary(validation.scored(validation.with_issues(papers(spark).limit(0), 2025))).first().total == 0


def test_ranking_and_filters(spark):
    ranked = {r.pos: r.score for r in ranking.rank(papers(spark), 2025).collect()}
    assert ranked[1] > ranked[2] and max(ranked.values()) <= 100
    assert rows(papers(spark).where(ranking.matches("deep", has_doi=True)).select("pos")) == [(1,), (2,)]
    assert rows(papers(spark).where(ranking.matches(years=(1900, 2030))).select("pos")) == [(1,)]
    assert [r.pos for r in papers(spark).orderBy(*ranking.sort_order("newest")).collect()] == [3, 1, 4, 2]
    assert [r.pos for r in papers(spark).orderBy(*ranking.sort_order("most_cited")).collect()] == [1, 4, 2, 3]


def test_duplicates(spark):
    assert rows(resolve.greedy_groups(papers(spark))) == [(1, 1), (2, 1), (3, 1), (4, 4)]
    chain = spark.createDataFrame([(1, "a", "x", None), (2, "b", "x", "u"), (3, "c", None, "u")], "pos long, title string, doi string, url string")
    assert rows(resolve.greedy_groups(chain)) == [(1, 1), (2, 1), (3, 3)]  # 2 is not kept, so it doesn't stand for 3
    assert rows(resolve.transitive_groups(chain)) == [(1, 1), (2, 1), (3, 1)]
    m = {r.group: r for r in resolve.merged(papers(spark)).collect()}
    assert m[1].authors == ["X", "Y"] and m[1].merged_from == "arxiv,openalex,other" and m[1].copies == 3 and m[1].year == 2020
    assert rows(resolve.kept_first(papers(spark)).select("pos")) == [(1,), (4,)]


def test_sinks(spark):
    old = spark.createDataFrame([(1, "unread"), (2, "read")], "id long, status string")
    new = spark.createDataFrame([(2, None), (3, "reading")], "id long, status string")
    assert rows(sinks.upserted(old, new, ["id"])) == [(1, "unread"), (2, None), (3, "reading")]
    assert rows(sinks.only_new(new, old, ["id"]).select("id")) == [(3,)]
    chunks = spark.createDataFrame([(0, "a"), (1, "b")], "chunk_index int, content string")
    vectors = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "chunk_index int, embedding array<double>")
    assert sinks.stored_chunks(chunks, vectors, 2).count() == 2 and sinks.stored_chunks(chunks, vectors.limit(1), 2).count() == 0
    a = sinks.artifact(spark.createDataFrame([(1, "x", 2)], "investigation_id long, a string, b int"), "collection").first()
    assert json.loads(a.payload) == {"a": "x", "b": 2}


def test_artifacts_on_disk(spark, tmp_path):
    a = sinks.artifact(spark.createDataFrame([(1, "x")], "investigation_id long, a string"), "landscape")
    sinks.write_artifacts(a, str(tmp_path / "out"))
    sinks.write_artifacts(a, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("artifact_type = 'landscape'").count() == 2


def test_landscape_and_gaps(spark):
    records = spark.createDataFrame([(1, ["Classes", "classes", " "], None), (2, ["Deep Learning"], ["x"])], "id long, k array<string>, d array<string>")
    terms = landscape.flattened(records, "id", {"k": F.col("k"), "d": F.col("d")})
    got = {(r.field, r.name): (r["count"], r.percentage) for r in landscape.clustered(terms).collect()}
    assert got == {("k", "class"): (2, 66.7), ("k", "deep learn"): (1, 33.3), ("d", "x"): (1, 100.0)}
    stats = landscape.statistics(spark.createDataFrame([(None,)], "c int"), "c").first()
    assert (stats.total, stats.average, stats.with_data) == (0, 0.0, 0)
    phrases = spark.createDataFrame([(1, "more data"), (1, "more data"), (1, "More data "), (1, "seen"), (1, "seen"), (1, "seen")], "investigation_id long, term string")
    answers = spark.createDataFrame([(1, "we have SEEN it"), (2, "more data")], "investigation_id long, text string")
    found = gaps.unanswered(phrases, answers, "future_work_gap").collect()
    assert [(r.subject, r.frequency, r.confidence) for r in found] == [("more data", 3, 0.38)]
    dated = spark.createDataFrame([(1, "technique", "old", 2001), (1, "technique", "Old ", 2002), (1, "methodology", "new", 2003), (1, "technique", "new", 2004), (1, "methodology", "older", 2001), (1, "methodology", "older", 2002)], "investigation_id long, kind string, term string, year int")
    assert [(r.subject, r.frequency, r.confidence, r.severity) for r in gaps.temporal_gap(dated).collect()] == [("old", 2, 0.4, "low"), ("older", 2, 0.4, "low")]
    four = spark.createDataFrame([(1, "technique", "gone", y) for y in range(2000, 2005)] + [(1, "technique", "x", y) for y in (2005, 2006)], dated.schema)
    assert [(r.subject, r.confidence, r.severity) for r in gaps.temporal_gap(four).collect()] == [("gone", 0.85, "medium")]
    little = spark.createDataFrame([(1, "technique", "a", 2001), (1, "technique", "a", 2002)], dated.schema)
    assert gaps.temporal_gap(little).collect() == [] and len(gaps.temporal_gap(little, years=spark.createDataFrame([(1, y) for y in (2001, 2002, 2003, 2004)], "investigation_id long, year int")).collect()) == 1
    out, errors = gaps.detect({"bad": lambda: 1 / 0, "good": lambda: gaps.temporal_gap(dated)})
    assert out.count() == 2 and "bad" in errors


def test_severity_and_confidence_of_gaps(spark):
    """Each rule's own: both frequencies for combinations, the share of texts for evaluation; shares round half to even."""
    bridge = "investigation_id long, paper_id long, name string"
    methods = spark.createDataFrame([(1, i, "m") for i in range(6)] + [(1, 10 + i, "few") for i in range(4)], bridge)
    techniques = spark.createDataFrame([(1, 20 + i, "t") for i in range(5)], bridge)
    assert [(r.subject, r.frequency, r.confidence, r.severity) for r in gaps.method_combination(methods, techniques).collect()] == [("m + t", 11, 0.55, "high"), ("few + t", 9, 0.45, "medium")]
    five = spark.createDataFrame([(1, "open question")] * 5, "investigation_id long, term string")
    assert [(r.confidence, r.severity) for r in gaps.unanswered(five, spark.createDataFrame([("no",)], "text string"), "limitation_gap").collect()] == [(0.62, "high")]
    say = lambda method, texts, at: [(1, method, t, at + i) for i, t in enumerate(texts)]
    texts = say("One ", ["Accuracy first"] * 5 + ["none"], 50) + say("two", ["F1 and recall"] * 6, 10) + say("three", ["bleu", "rouge", "auc"] * 3, 0) + say("half", ["map"] * 3 + ["none"] * 3, 1) + say("short", ["map"] * 5, 2) + say("late", ["map"] * 6, 90) + say("later", ["map"] * 6, 99)
    got = gaps.evaluation_gap(spark.createDataFrame(texts, "investigation_id long, method string, text string, pos long")).collect()
    assert [(r.subject, r.frequency, r.confidence, r.severity) for r in got] == [("two", 6, 0.85, "low"), ("one", 5, 0.83, "medium"), ("late", 6, 0.85, "medium")]


def test_strengths_weaknesses_and_lists(spark):
    """Every label at both sides of its bound."""
    names = ["institution", "paper_count", "citation_count", "avg_citations", "growth_rate", "domain_count", "collaboration_score", "technology_count"]
    kinds = "institution string, paper_count long, citation_count long, avg_citations double, growth_rate double, domain_count long, collaboration_score double, technology_count long"
    data = [("high", 11, 101, 10.01, 0.51, 4, 0.51, 1), ("edge", 10, 100, 10.0, 0.5, 3, 0.5, 2), ("low", 2, 9, 2.99, -0.01, 0, 0.09, 3), ("least", 3, 10, 3.0, 0.0, 1, 0.1, 4), ("new", 1, 1, 1.0, 0.3, 1, 0.0, 5)]
    e = spark.createDataFrame(data, kinds)
    assert e.columns == names
    got = {r.institution: (r.strengths, r.weaknesses) for r in institutions.compare(e, ["high", "edge", "low", "least"]).collect()}
    assert got["high"] == ("; ".join(t for t, *_ in institutions.STRENGTHS), "") and got["edge"] == ("", "")
    assert got["low"] == ("", "; ".join(t for t, *_ in institutions.WEAKNESSES)) and got["least"] == ("Broad research diversity", "")
    lists = {}
    for r in institutions.leaders(e, 2).orderBy("rank").collect():
        lists.setdefault(r["list"], []).append(r.institution)
    assert lists == {
        "top_institutions": ["high", "edge"], "emerging_institutions": ["high", "edge"], "most_collaborative": ["high", "edge"], "fastest_growing": ["high", "edge"],
        "technology_leaders": ["new", "least"], "dataset_leaders": ["high", "edge"], "methodology_leaders": ["high", "edge"],
    }
    assert [r.institution for r in institutions.leaders(e, 10).where("list = 'emerging_institutions'").orderBy("rank").collect()] == ["high", "edge"]


def test_answers_that_hold_for_all(spark):
    terms = spark.createDataFrame([(1, "ab"), (2, "ab"), (2, "b c"), (3, "\tab"), (3, "zz"), (4, " ")], "investigation_id long, term string")
    got = gaps.answered(terms, spark.createDataFrame([("CAB cd",), (None,)], "text string"))
    assert rows(got) == [("ab",), ("b c",)]


def test_answered_by_brute_force(spark):
    """Terms of one, two and more words, parts of words at either end, odd white space."""
    import random

    rng = random.Random(3)
    alphabet = ["art", "start", "tar", "ta", "data", "more data", "a", "x\ty", "is"]
    texts = [(rng.randint(1, 2), " ".join(rng.choices(alphabet, k=rng.randint(0, 6)))) for _ in range(40)]
    terms = {(rng.randint(1, 3), " ".join(rng.choices(["art", "ar", "tar", "data", "at", "more", "s", "is", "t"], k=rng.randint(1, 4)))) for _ in range(300)} | {(1, "x\ty"), (1, "data x\ty s"), (2, "t  d")}
    got = gaps.answered(spark.createDataFrame(list(terms), "investigation_id long, term string"), spark.createDataFrame([*texts, (1, None)], "investigation_id long, text string"))
    want = sorted(((i, t) for i, t in terms if any(j == i and t in x for j, x in texts)), key=repr)
    assert rows(got) == want and 20 < len(want) < len(terms) - 20


def test_institutions(spark):
    score = lambda n, q: one(spark, institutions.name_score(F.lit(n), q))
    assert [score("Massachusetts Institute of Technology", q) for q in ("mit", "mass", "massachusetts institute of technology", "institute", "zz")] == [0.85, 0.9, 1.0, 0.7, 0.0]
    assert score("Institute of Technology", "tech labs") == pytest.approx(0.2)
    e = spark.createDataFrame([("Standford", 3), ("Oxford", 5)], "institution string, paper_count int")
    assert [r.institution for r in institutions.search(e, "stanford", fuzzy=True).collect()][0] == "Standford"
    assert institutions.search(e, "  ").count() == 0


def test_retrieval(spark):
    assert list(retrieval.chunk_spans("x" * 1700)) == [(0, 800), (720, 1520), (1440, 1700)]
    assert list(retrieval.chunk_spans("a" * 500 + "\n" + "b" * 500)) == [(0, 500), (420, 1001)]
    assert list(retrieval.chunk_spans("  ")) == []
    s = spark.createDataFrame([("q", 1, 6), ("q", 2, 7), ("q", 3, 3)], "query string, pos int, char_count int")
    assert rows(retrieval.within_budget(s, ["query"], 10, [F.col("pos")]).select("pos")) == [(1,), (3,)]
    q = spark.createDataFrame([(1, 'Compare "ViT" and "Swin Transformer"'), (2, "Compare approaches for image classification"), (3, 'What does "BERT" say about masking?'), (4, "What are the limitations of this?"), (5, "latest news"), (6, "hello")], "id int, text string")
    got = {r.id: r.intent for r in retrieval.classified(q).collect()}
    assert got == {1: "paper_comparison", 2: "methodology_comparison", 3: "paper_summary", 4: "limitation_analysis", 5: "trend_analysis", 6: "general_research_question"}
    a = retrieval.analyzed(q).where("id = 4").first()
    assert a.keywords == ["limitations"] and a.signals_gap == ["limitations of", "limitations", "the limitations"] or sorted(a.signals_gap) == a.signals_gap
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id int, embedding array<float>")
    assert [r.vec_id for r in retrieval.nearest(v, [1.0, 0.0], 2).collect()] == [1, 3]
    found = lambda t, c: one(spark, retrieval.citation_found(F.lit(t), F.lit(c)))
    assert found("Deep Nets (2020)", "on deep nets") and not found("", "x") and found("alpha beta gamma delta omega", "delta gamma alpha") and not found("abc", "zzz")
    sections = spark.createDataFrame([("q", "L", "s1", 1, "a b c d", 9.0), ("q", "L", "s2", 2, "a b c x", 8.0), ("q", "M", "s3", 3, "a b c d", 7.0)], "query string, label string, source string, pos int, content string, score double")
    assert rows(retrieval.compressed(sections, ["query"], 0.6).select("pos")) == [(1,), (3,)]
    claims = spark.createDataFrame([("q", 1, "- this suggests a long claim\nshort\n[1] this suggests a long claim too", 50.0)], "query string, pos int, content string, score double")
    out = retrieval.aggregated_evidence(claims, ["query"]).collect()
    assert [(r.claim, r.confidence, r.is_inference) for r in out] == [("this suggests a long claim", 0.5, True)]


def test_logs(spark):
    e = spark.createDataFrame([(i, "k", f"2024-01-01 00:00:{i * 10:02d}") for i in range(4)], "id long, key string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.allowed for r in logs.tumbling_limit(e, 3, 60).orderBy("id").collect()] == [True, True, True, False]
    assert one(spark, logs.policy(F.lit("POST"), F.lit("/api/v1/investigations/"))) == 10 and one(spark, logs.policy(F.lit("POST"), F.lit("/x/investigations"))) == 120
    assert one(spark, logs.policy(F.lit("GET"), F.lit("/api/v1/health"))) is None and one(spark, logs.policy(F.lit("GET"), F.lit("/health"))) == 120
    assert one(spark, logs.policy(F.lit("GET"), F.lit("/api/v1/health"), {("get", "/api/v1/health"): 7})) == 7
    assert one(spark, F.map_entries(logs.merged_metadata(F.expr("map('a', 1, 'b', 2)"), F.expr("map('b', 3)"))))[1].value == 3


def test_unicode_and_builder(spark):
    from sparkfolio.functions.unicode import nfkc, strip_accents

    df = spark.createDataFrame([("École",), ("plain",), (None,)], "t string")
    assert [r.x for r in df.select(strip_accents(F.col("t")).alias("x")).collect()] == ["Ecole", "plain", None]
    assert one(spark, nfkc(F.lit("ﬁne"))) == "fine"
    raw = spark.createDataFrame([(1, "methodology", "RL"), (1, "technique", "Transformers"), (1, "domain", "Computer Vision"), (1, "author", " Jane "), (1, "dataset", None)], "paper_id int, type string, name string")
    assert rows(graph.built(raw)) == [(1, "author", "Jane"), (1, "domain", "computer vision"), (1, "methodology", "Transformer"), (1, "methodology", "reinforcement learn")]
    a = spark.createDataFrame([(1, "landscape", "2024-01-01", '{"format": "json"}'), (2, "landscape", "2024-01-02", '{"format": "json"}'), (3, "landscape", "2024-01-03", '{"format": "markdown"}')], "id int, artifact_type string, created_at string, payload string")
    assert sinks.latest_of_format(a, "landscape", "json").first().id == 2


def test_json_repair(spark):
    cases = {'```json\n{"a": 1}\n```': '{"a":1}', 'Sure: {"a": {"b": "}"}} ok': '{"a":{"b":"}"}}', "[1, 2]": "[1,2]", "no json": None, "": None, '{"a": "\\"}"}': '{"a":"\\"}"}'}
    assert {k: json_repair.repaired(k) for k in cases} == cases
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    assert {r.t: r.j for r in df.withColumn("j", json_repair.repair_json(F.col("t"))).collect() if r.t is not None} == cases
    whole = json.dumps({"x": 1, "answer": 'a "q" \\ \n é 😀 end', "y": 2})
    for step in (1, 2, 5, 100):
        s = json_repair.AnswerStream()
        assert "".join(s.feed(whole[i : i + step]) for i in range(0, len(whole), step)) == 'a "q" \\ \n é 😀 end'
    assert one(spark, json_repair.payload_items(F.lit('{"results": [1]}'))) == "[1]"
