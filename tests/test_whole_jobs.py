"""Registered queries on small tables of known content: every row counts, whatever its id, length or language."""

import pytest

from sparkfolio.plans import registry

from .conftest import rows


@pytest.fixture
def run(spark, tmp_path):
    """Runs a query over tables given as name=(rows, schema)."""

    def of(query, **tables):
        for name, (data, schema) in tables.items():
            spark.createDataFrame(data, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return registry.QUERIES[query](spark, str(tmp_path))

    return of


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars int"
BENCHMARK = "item_id long, text string"


def documents(texts, lang="en", source="s"):
    return [(k, t, lang, source, len(t)) for k, t in enumerate(texts)], DOCUMENTS


def test_gap_evaluation_reads_whole_texts(spark):
    from sparkfolio.operators.gaps import evaluation_gap

    told = lambda texts: evaluation_gap(spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "pos long, text string, investigation_id string, method string")).collect()
    assert [(r.subject, r.frequency) for r in told(["words " * 1000 + "we report the Accuracy only"] * 8)] == [("s", 8)]
    assert told(["at the end accuracy, recall and latency"] * 8) == [] and told(["nothing of the kind"] * 10) == []


PART = ([(1, "cold widget", "Brand#1", "PROMO"), (2, "cold phrase", "Brand#2", "PROMO"), (3, "cold bolt", "Brand#3", "PROMO")], "p_partkey long, p_name string, p_brand string, p_type string")


@pytest.mark.parametrize("query,more", [("gap_future_work", []), ("gap_limitations", [("PROMO", "cold", 3)])])
def test_unanswered_takes_every_line_and_every_answer(run, query, more):
    odd = ([(2 * k + 1, "Odd ones\nshort\nan answered phrase\npromo", "en", "s", 1) for k in range(3)], DOCUMENTS)
    answers = ([(0, "nothing"), (1, "here is An Answered Phrase indeed"), (2, "promo"[: 5 * (query == "gap_future_work")])], BENCHMARK)
    assert [(r[0], r[2], r[3]) for r in rows(run(query, documents=odd, benchmark=answers, part=PART))] == [*more, ("s", "odd ones", 3), ("s", "short", 3)]


def test_keyword_scores_every_document(run):
    import re

    texts = [("The end of the thonan", "en"), ("die the", "de"), ("que pasa, que", "es"), ("le que", None), ("İİ the of the er", "en"), ("x", "the"), ("", "en")]
    data = [(k, t, lang, "s", len(t)) for k, (t, lang) in enumerate(texts)]

    def brute(text, lang):
        t = text.lower()
        words = len(re.findall(r"\b(?:the|que)\b", t, re.ASCII))
        return 10.0 * words + 15.0 * t.count("of the") + 100.0 * ("thonan" in t) + 30.0 * ((lang or "").lower() == "the") + 12.0 * ("er" in t) + 20.0

    assert rows(run("keyword_scores", documents=(data, DOCUMENTS))) == [(k, brute(t, lang)) for k, (t, lang) in enumerate(texts)]


def test_rank_and_sort_every_paper(run):
    """Sixty papers and more, in an order that a plain sort gives."""
    names = ["apple", "Banana", "cherry", "Apple", "date"]
    docs = ([(k, f"{names[k % 5]}\nabstract", "en", "s", 1) for k in range(130)], DOCUMENTS)
    ranked = sorted(run("rank_papers", documents=docs).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 131)) and {r.pos for r in ranked} == set(range(130))
    assert all(a.score >= b.score for a, b in zip(ranked, ranked[1:]))
    got = {}
    for r in run("sort_papers", documents=docs).collect():
        got.setdefault(r.mode, {})[r.position] = r.pos
    assert all(sorted(places) == list(range(1, 131)) for places in got.values())
    order = {mode: [places[k] for k in range(1, 131)] for mode, places in got.items()}
    year, cited = lambda k: 1890 + k % 140, lambda k: k % 97 - 3
    title = {"apple": 0, "Apple": 1, "Banana": 2, "cherry": 3, "date": 4}
    assert order == {
        "newest": sorted(range(130), key=lambda k: (-year(k), k)),
        "oldest": sorted(range(130), key=lambda k: (year(k), k)),
        "most_cited": sorted(range(130), key=lambda k: (-cited(k), k)),
        "alphabetical": sorted(range(130), key=lambda k: (title[names[k % 5]], k)),
    }


def test_transitive_groups_follow_long_chains(spark):
    """Each paper shares its DOI with the one before and its URL with the one after, or the other way round; ids are mixed."""
    from sparkfolio.operators import resolve

    n = 60
    at = {k: k * 37 % n for k in range(n)}  # place in the chain -> pos
    data = [(at[k], f"title {k}", f"10.1/{k // 2}", f"http://h/{(k + 1) // 2}") for k in range(n)] + [(n, "alone", None, None)]
    papers = spark.createDataFrame(data, "pos long, title string, doi string, url string")
    assert rows(resolve.transitive_groups(papers)) == sorted([(k, 0) for k in range(n)] + [(n, n)], key=repr)
    kept, owner = [], set()
    keys = {p: {f"t{t}", *([f"d{d}", f"u{u}"] if d else [])} for p, t, d, u in data}
    for p in sorted(keys):
        if not keys[p] & owner:
            kept.append(p)
            owner |= keys[p]
    assert sorted(r.pos for r in resolve.greedy_groups(papers).where("pos = group").collect()) == kept


def test_retrievals_run_over_chunks_of_documents(run):
    texts = ["the of end", "x " * 1000, "Das Ende", "the " + "y" * 1700]
    got = run("embed_documents", documents=documents(texts)).collect()
    assert sorted((r.doc_id, r.chunk_index) for r in got) == [(0, 0), (1, 0), (1, 1), (1, 2), (2, 0), (3, 0), (3, 1), (3, 2)]
    assert {len(r.embedding) for r in got} == {384}
    found = run("retrieve_by_keywords", documents=documents(texts)).collect()
    assert [(r.pos >> 22, r.pos & 0x3FFFFF, r.score) for r in sorted(found, key=lambda r: r.pos)] == [(0, 0, 20.0), (3, 0, 10.0)]
    turns = ([(1, 0, "user", "the end of it"), (1, 1, "assistant", "x"), (1, 2, "user", "Das Ende"), (2, 0, "user", None)], "conv_id long, turn int, role string, text string")
    near = run("retrieve_semantically", documents=documents(texts), conversations=turns).collect()
    assert {(r.question_id >> 16, r.question_id & 0xFFFF) for r in near} == {(1, 0), (1, 2)} and {r.pos >> 22 for r in near} == {0, 1, 2, 3}


def test_institution_search_finds_similar_names(run):
    """All branches of a name's score by brute force, the last one (a sequence ratio) too."""
    from difflib import SequenceMatcher

    names = ["NATION_1", "NATION_12", "NATION_2", "NATYON_1", "Natoin 1", "Elsewhere", "The Nation", "nation_1"]
    supplier = ([(k, f"S{k}", k) for k in range(len(names))], "s_suppkey long, s_name string, s_nationkey long")
    nation = (list(enumerate(names)), "n_nationkey long, n_name string")
    lineitem = ([(k, 1, k, "A", "F") for k in range(len(names))], "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string")

    def brute(name, q):
        n, words = name.lower(), name.lower().split()
        if n == q:
            return 1.0
        if n.startswith(q):
            return 0.9
        if len(words) >= 2 and "".join(w[0] for w in words if w != "the") == q:
            return 0.85
        if q in n:
            return 0.7
        hits = sum(any(t in w for w in words) for t in q.split())
        if hits:
            return 0.4 * hits / len(q.split())
        ratio = SequenceMatcher(None, n, q).ratio()
        return 0.3 * ratio if ratio > 0.6 else 0.0

    want = {(q, n, round(s, 4)) for q in ("nation_1", "nation", "on_2", "ation 7") for n in names if (s := brute(n, q)) > 0}
    assert ("nation_1", "NATYON_1", 0.2625) in want
    assert {(r.q, r.institution, r.relevance_score) for r in run("institution_search", supplier=supplier, nation=nation, lineitem=lineitem).collect()} == want


def test_citations_check_every_item_in_every_document(spark, run):
    from pyspark.sql import functions as F

    from sparkfolio.operators import retrieval as R

    titles = ["Deep residual learning for image recognition", "Un", "  Attention (2017) Is All ", "graph (x)", "", "word word word other", "[a] b", "never quoted anywhere else"] + [f"item number{k}" for k in range(8, 50)]
    texts = ["on deep RESIDUAL learning", "unearned", "we cite attention is all", "attentionis all", "graphs", "so wordy", "atten[1] tionis all", "b", "item number49 and item number8", "", "xx [a] b item [z] number41", "other prose " * 30]
    docs, bench = documents(texts), (list(enumerate(titles)), BENCHMARK)
    got = run("validate_citations", documents=docs, benchmark=bench).collect()
    d, b = spark.createDataFrame(*docs), spark.createDataFrame(*bench)
    want = {(r.item_id, r.doc_id) for r in d.crossJoin(b.withColumnRenamed("text", "title")).where(R.citation_found(F.col("title"), F.col("text"))).collect()}
    assert {(r.item_id, r.doc_id) for r in got if r.found} == want and (49, 8) in want
    assert {r.item_id for r in got if not r.found} == set(range(50)) - {i for i, _ in want}


def test_artifact_sections_take_every_document(run):
    import hashlib

    texts = [f"gap {k} {'long ' * 20}end" for k in range(7)]
    got = {r.label: r.content for r in run("artifact_sections", documents=documents(texts)).collect()}
    assert got["Research Gaps"] == hashlib.md5("\n".join(f"{t}: d" for t in texts).encode()).hexdigest()
