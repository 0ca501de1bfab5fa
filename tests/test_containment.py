"""Terms in texts, titles in documents and claims, against brute force."""

import random
import re

from pyspark.sql import functions as F

from sparkfolio.operators import containment, retrieval

from .conftest import rows


def test_contained_by_brute_force(spark):
    rng = random.Random(5)
    parts = ["art", "start", "tar", "ta", "data", "more data", "a", "x\ty", "is", "é", "日本 語", "s  t"]
    texts = [(k % 3, k, " ".join(rng.choices(parts, k=rng.randint(0, 7)))) for k in range(60)] + [(0, 99, None)]
    terms = list({(rng.randint(0, 3), " ".join(rng.choices(["art", "ar", "tar", "data", "at", "s", "is", "t", "é", "本 語", "a"], k=rng.randint(1, 4)))) for _ in range(300)} | {(0, "x\ty"), (1, "s  t"), (1, " ta"), (2, "\ta"), (0, " ")})
    t, d = spark.createDataFrame(terms, "g long, term string"), spark.createDataFrame(texts, "g long, id long, text string")
    want = sorted({(g, t, i) for g, t in terms if t.split() for h, i, x in texts if g == h and t in (x or "")}, key=repr)
    assert rows(containment.contained(t, d, ["g"])) == want and len(want) > 300
    alone = sorted({(t, i) for _, t in terms if t.split() for _, i, x in texts if t in (x or "")}, key=repr)
    assert rows(containment.contained(t.select("term"), d.select("id", "text"))) == alone
    assert containment.contained(t.limit(0), d, ["g"]).collect() == [] and containment.contained(t, d.limit(0), ["g"]).collect() == []


def cited(title, text):
    """As it is defined, one title and one text at a time."""
    if not title or not title.strip():
        return False
    t, c = title.strip().lower(), (text or "").lower()
    bare = re.sub(r"\s*\([^)]*\)\s*", "", t).strip()
    tokens = re.findall("[a-zA-Z0-9]{4,}", t)
    return t in c or (bare != "" and (bare in c or bare in re.sub(r"\[.*?\]\s*", "", c))) or (bool(tokens) and sum(w in c for w in tokens) >= max(3, len(tokens) // 2))


def test_citations_by_brute_force(spark):
    rng = random.Random(8)
    words = ["deep", "learning", "graph", "nets", "of", "attention", "is", "all", "need", "wordy", "transform", "transformer", "xgraphs", "data", "a", "b2b4", "vision"]
    title = lambda: " ".join(rng.choices(words, k=rng.randint(1, 9))) + rng.choice(["", "", " (2017)", " (a b) end"])
    items = [(k, title()) for k in range(150)] + [(200, None), (201, ""), (202, " "), (203, "Graph"), (204, "graph"), (205, "(all)"), (206, "word word word other"), (207, "[a] b")]
    said = lambda: " ".join(rng.choices([*words, "[1]", "[x y] ", "pre-graph", "Deep", "\n", "(2017)"], k=rng.randint(0, 14)))
    docs = [(k, said()) for k in range(120)] + [(300, None), (301, ""), (302, docs_copy := said() + " deep learning of graph nets"), (303, docs_copy), (None, "graph"), (304, "a [a] b c")]
    docs += [(400 + k, rng.choice(items[:150])[1].replace(" ", rng.choice([" ", " [3] "])) + " and more") for k in range(20)]
    out = retrieval.citations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, title string")).collect()
    want = {(i, d) for i, t in items for d, x in docs if cited(t, x)}
    assert {(r.item_id, r.doc_id) for r in out if r.found} == want and len(want) > 500
    assert {(r.item_id, r.doc_id) for r in out if not r.found} == {(i, None) for i, _ in items} - {(i, None) for i, _ in want}
    assert len(out) == len({(r.item_id, r.doc_id) for r in out})


def test_citations_do_not_pass_through_the_driver(spark, monkeypatch):
    """As many titles as documents: a join of keys, with neither a collect nor a cross join."""
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("about thing"), F.col("id").cast("string"), F.lit(" and more of it")).alias("text"))
    items = spark.range(500).select(F.col("id").alias("item_id"), F.concat(F.lit("thing"), F.col("id").cast("string"), F.lit(" and more")).alias("title"))
    df = retrieval.citations(docs, items)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert df.where("found").select("item_id", "doc_id").where("item_id = doc_id").count() == 500


def test_title_mentions(spark):
    claims = spark.createDataFrame([(1, "Uses BERT and Deep Nets"), (1, "robert is no title"), (2, "bert"), (1, "abcdefg")], "q long, claim string")
    titles = spark.createDataFrame([(1, "BERT"), (1, "deep nets"), (1, "missing"), (2, "GPT"), *[(1, x) for x in "abcdefg"]], "q long, paper_title string")
    got = rows(retrieval.title_mentions(claims, titles, ["q"]))
    letters = [(1, "abcdefg", x) for x in "abcde"]
    first = sorted(["BERT", "deep nets", "a", "b", "d", "e"])[:5]
    assert got == sorted([*[(1, "Uses BERT and Deep Nets", x) for x in first], *[(1, "robert is no title", x) for x in sorted(["BERT", "b", "e", "a"]) if x.lower() in "robert is no title"], *letters], key=repr)
