"""What wide tables are shuffled by, read from plans: a row a line item, not a row a name, and each only once."""

import os

import pytest

from sparkfolio.plans import registry
from sparkfolio.sources.corpus import Corpus

DATA = os.environ.get("SPARKFOLIO_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return [line for line in plan(df).splitlines() if "Exchange hashpartitioning" in line]


def test_entities_are_made_after_the_shuffle(spark):
    found = shuffles(Corpus(spark, DATA).entities())
    assert found and all("hashpartitioning(paper_id" in s and "name" not in s.split("),")[0] for s in found)


@pytest.mark.parametrize("name", ["graph_edges", "graph_induced"])
def test_edges_of_papers_are_not_joined(spark, name):
    text = plan(registry.QUERIES[name](spark, DATA))
    assert not [s for s in text.splitlines() if "Exchange hashpartitioning(paper_id" in s and "name" in s.split("),")[0]]
    assert name != "graph_induced" or "paper:" not in text


@pytest.mark.parametrize("name", ["gap_summary", "institution_details", "landscape_texts", "landscape_sections"])
def test_line_items_are_read_once(spark, name):
    """What is left to run reads tables made of them."""
    assert "l_partkey" not in plan(registry.QUERIES[name](spark, DATA))


def test_texts_have_short_ids(spark, monkeypatch):
    """What citations shuffles and writes for each word of a text has its id beside it: 16 bytes, not their 32 letters."""
    from sparkfolio.operators import containment, retrieval

    seen = []
    monkeypatch.setattr(containment, "index_of", lambda texts, on, made=containment.index_of: seen.append(dict(texts.dtypes)["id"]) or made(texts, on))
    documents = spark.createDataFrame([(1, "A Title stands here"), (2, "a title stands here"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a title"), (8, "Another")], "item_id long, title string")
    assert sorted(map(tuple, retrieval.citations(documents, items).collect()), key=repr) == [(7, 1, True), (7, 2, True), (8, None, False)]
    assert seen and set(seen) == {"binary"}
