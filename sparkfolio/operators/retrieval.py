"""Chunks, vector search, keyword scores, budgets, evidence, citations, confidence and questions of retrieval."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized_claim, strip
from ..functions.words import (
    COMPARE_WORDS, COMPARISON, DATASET_WORDS, EVIDENCE_PHRASES, EXACT_SIGNALS, FUTURE_PHRASES, GAP_WORDS, HEDGES, HOW_WHY, LABEL_ALIASES, LIMITATION_PHRASES,
    METHOD_WORDS, PAPER_WORDS, SIGNALS, STOP_WORDS, SUMMARY_PHRASES, TECHNOLOGY_WORDS, TREND_PHRASES,
)
from ..session import stored
from ..shipping import ship
from . import containment
from .apart import kept_apart, overlapping, rare_first, word_set
from .graph import top_n

CHUNK, OVERLAP = 800, 80


# -- chunks ---------------------------------------------------------------------------------------------------------------
def chunk_spans(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Spans of a text: whole if it fits, else of size characters, ending at the last line break of their second half if there is one, with an overlap."""
    n, start = len(text), 0
    if not text.strip():
        return
    while True:
        end = min(start + size, n)
        if end < n:
            at = text.rfind("\n", start + size // 2, end)
            end = at if at > start else end
        yield start, end
        if end >= n:
            return
        start = end - overlap


def chunked(sections: DataFrame, id_column: str, content: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """id_column, chunk_index, content: each text's chunks. Cuts depend on earlier cuts, so texts are walked in Arrow batches."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    ship(sections.sparkSession)
    kind = sections.schema[id_column].dataType
    schema = pa.schema([(id_column, to_arrow_type(kind)), ("chunk_index", pa.int32()), ("content", pa.string())])

    def run(batches):
        for batch in batches:
            ids, index, parts = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, (a, b) in enumerate(chunk_spans(text or "", size, overlap)):
                    ids.append(key)
                    index.append(k)
                    parts.append(text[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(ids, schema.types[0]), pa.array(index, pa.int32()), pa.array(parts, pa.string())], schema=schema)

    return sections.select(id_column, content).mapInArrow(run, f"{id_column} {kind.simpleString()}, chunk_index int, content string")


# -- vectors --------------------------------------------------------------------------------------------------------------
def cosine_distance(vector: Column, query: list[float]) -> Column:
    """1 less the cosine, in double precision; null where a norm is zero."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    own = sum(x * x for x in query) ** 0.5
    return F.when(norm * own > 0, 1 - dot / (norm * own))


def nearest(vectors: DataFrame, query: list[float], k: int, min_score: float | None = None) -> DataFrame:
    """vec_id, score of the k nearest; the least score is asked for after the limit. A partial top k per partition, no global sort."""
    top = vectors.select("vec_id", cosine_distance(F.col("embedding"), query).alias("_d")).orderBy("_d", "vec_id").limit(k)
    out = top.select("vec_id", (1 - F.col("_d")).alias("score"))
    return out if min_score is None else out.where(F.col("score") >= min_score)


def hashed_words(dimensions: int):
    """An offline stand-in for a sentence model: hashed words, of unit length."""
    import zlib

    import numpy as np

    def vectors(texts: list[str]) -> list:
        out = []
        for text in texts:
            v = np.zeros(dimensions, np.float32)
            for w in text.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dimensions] += 1 if h & 1 << 20 else -1
            out.append(v / (np.linalg.norm(v) or 1))
        return out

    return vectors


def embed(texts: DataFrame, content: str, dimensions: int = 384, embedder=None, batch: int = 32) -> DataFrame:
    """texts with embedding array<float>. embedder() is called once in each task (a model is loaded there) and gives a function from
    a list of at most batch texts to their vectors; without one, hashed_words() stands in."""
    ship(texts.sparkSession)

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = hashed_words(dimensions) if embedder is None else embedder()
        for s in batches:
            items = [x or "" for x in s]
            yield pd.Series([v for at in range(0, len(items), batch) for v in model(items[at : at + batch])])

    return texts.withColumn("embedding", vectors(F.col(content)))


def to_embed(artifacts: DataFrame, stored: DataFrame) -> DataFrame:
    """Artifacts (id, payload) whose content isn't embedded yet (stored: id, content_hash): incremental by content, not by version."""
    return artifacts.withColumn("content_hash", F.sha2(F.col("payload").cast("binary"), 256)).join(stored.select("id", "content_hash"), ["id", "content_hash"], "left_anti")


# -- questions ------------------------------------------------------------------------------------------------------------
TOKEN = r"[a-zA-Z][a-zA-Z0-9_\-.#]*"


def words(items: list[str]) -> Column:
    return F.array(*map(F.lit, items))


def any_in(raw: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out |= F.contains(raw, F.lit(p))
    return out


def analyzed(questions: DataFrame, text: str = "text") -> DataFrame:
    """questions with tokens, keywords, bigrams, phrases, signals_* (sorted) and is_comparison, is_how_why."""
    raw = strip(F.lower(F.col(text)))
    stop = words(STOP_WORDS)
    df = questions.withColumn("raw", raw).withColumn("tokens", F.regexp_extract_all("raw", F.lit(f"({TOKEN})"), F.lit(1)))
    keywords = F.array_distinct(F.filter("tokens", lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t)))
    n = F.size("tokens")
    pairs = F.when(n > 1, F.zip_with(F.slice("tokens", 1, n - 1), F.slice("tokens", 2, n - 1), lambda a, b: F.when(~F.array_contains(stop, a) | ~F.array_contains(stop, b), F.concat(a, F.lit(" "), b)))).otherwise(F.array().cast("array<string>"))
    phrases = F.filter(F.transform(F.regexp_extract_all("raw", F.lit('"([^"]+)"'), F.lit(1)), strip), lambda p: F.length(p) > 2)
    df = df.withColumns({"keywords": keywords, "bigrams": F.filter(F.array_distinct(F.array_compact(pairs)), lambda b: F.length(b) > 3), "phrases": phrases})
    terms = F.array_union(F.array_union("keywords", "bigrams"), "phrases")
    for name, triggers in SIGNALS.items():
        df = df.withColumn(f"signals_{name}", F.sort_array(F.filter(terms, _has_any(triggers))))
    for name, triggers in EXACT_SIGNALS.items():
        df = df.withColumn(f"signals_{name}", F.sort_array(F.array_intersect(terms, words(triggers))))
    return df.withColumns({"is_comparison": F.arrays_overlap("tokens", words(COMPARISON)), "is_how_why": F.arrays_overlap("tokens", words(HOW_WHY))})


def _has_any(triggers: list[str]):
    return lambda t: any_in(t, triggers)


def classified(questions: DataFrame, text: str = "text") -> DataFrame:
    """questions with intent, paper_mentions, comparison_targets: the first rule that fits of ten intents."""
    df = questions.withColumn("_raw", strip(F.lower(F.col(text)))).withColumn("_t", F.regexp_extract_all("_raw", F.lit(f"({TOKEN})"), F.lit(1)))
    mentions = F.transform(F.regexp_extract_all(F.col(text), F.lit('"([^"]+)"'), F.lit(1)), strip)
    compared = r"(?i)(?:compare|between)\s+(.+?)\s+and\s+(.+?)(?:\?|$|\.)"
    side = lambda k: F.regexp_replace(strip(F.regexp_extract(F.col(text), compared, k)), '^"+|"+$', "")
    targets = F.filter(F.array(side(1), side(2)), lambda x: x != "")
    df = df.withColumns({"paper_mentions": mentions, "comparison_targets": targets})
    has = lambda ws: F.arrays_overlap("_t", words(ws))
    raw, mentioned = F.col("_raw"), F.size("paper_mentions") > 0
    comparing = has(COMPARE_WORDS) | (F.size("comparison_targets") > 0)
    implicit = F.regexp_extract("_raw", r"\bwhich\s+(.+?)\s+(?:is|are)\s+most", 1)
    about = lambda ws: (implicit != "") & (implicit.isin(*ws) | any_in(implicit, [w for w in ws if len(w) > 4]))
    other = has([*METHOD_WORDS, *DATASET_WORDS, *TECHNOLOGY_WORDS, *GAP_WORDS])
    intent = (
        F.when(comparing & (mentioned | ((F.size("comparison_targets") >= 2) & has(PAPER_WORDS))), "paper_comparison")
        .when(comparing & has(TECHNOLOGY_WORDS), "technology_comparison")
        .when(comparing & has(METHOD_WORDS), "methodology_comparison")
        .when(comparing & has(DATASET_WORDS), "dataset_comparison")
        .when(about(METHOD_WORDS), "methodology_comparison")
        .when(about(DATASET_WORDS), "dataset_comparison")
        .when(about(TECHNOLOGY_WORDS), "technology_comparison")
        .when(mentioned & (any_in(raw, SUMMARY_PHRASES) | ~other), "paper_summary")
        .when(has(GAP_WORDS) & any_in(raw, LIMITATION_PHRASES), "limitation_analysis")
        .when(has(GAP_WORDS) | any_in(raw, FUTURE_PHRASES), "research_gap_exploration")
        .when(any_in(raw, TREND_PHRASES), "trend_analysis")
        .when(any_in(raw, EVIDENCE_PHRASES), "evidence_lookup")
        .otherwise("general_research_question")
    )
    return df.withColumn("intent", intent).drop("_raw", "_t")


# How many chunks an intent asks for, and the labels and sources that it prefers.
STRATEGIES = {
    "paper_summary": (30, ["Key Findings", "Summary", "Research Questions"], []), "paper_comparison": (40, [], ["Knowledge Package"]), "methodology_comparison": (30, ["Methodologies"], []), "dataset_comparison": (30, ["Datasets", "Evaluation Metrics"], []),
    "technology_comparison": (30, ["Technologies"], []), "limitation_analysis": (25, ["Limitations", "Future Work"], []), "research_gap_exploration": (25, ["Research Gaps", "Recommendations", "Limitations", "Future Work"], ["Gap Report", "Research Gap Report"]),
    "trend_analysis": (30, [], ["Landscape", "Research Landscape"]), "evidence_lookup": (25, [], ["Knowledge Package"]), "general_research_question": (20, [], []),
}


# -- scores ---------------------------------------------------------------------------------------------------------------
def occurrences(text: Column, term: Column) -> Column:
    """How often a term stands in a text without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int")


def keyword_score(question: dict[str, list[str]], content: Column, label: Column) -> Column:
    """Points of a section for an analysed question (lists keywords, bigrams, phrases and signals by kind): words 10, bigrams 15, phrases 100,
    label or its aliases 30, signals 12 (words as ASCII letters bound them), and 20 for each gap signal that the question has. A null content
    or label has no points of its own."""
    text, name = F.lower(F.coalesce(content, F.lit(""))), F.lower(F.coalesce(label, F.lit("")))
    score = F.lit(0.0)
    for k in question.get("keywords", []):
        score += 10.0 * F.regexp_count(text, F.lit(rf"(?<!\w)\Q{k}\E(?!\w)"))
    for b in question.get("bigrams", []):
        score += 15.0 * occurrences(text, F.lit(b))
    for p in question.get("phrases", []):
        score += 100.0 * F.contains(text, F.lit(p)).cast("int")
    asked = {*question.get("keywords", []), *question.get("bigrams", [])}
    if asked:
        score += 30.0 * name.isin(*asked).cast("int")
    for own, aliases in LABEL_ALIASES.items():
        hits = len(asked & set(aliases))
        if hits:
            score += F.when(name == own, 30.0 * hits).otherwise(0.0)
    for kind in ("methodology", "dataset", "technology", "domain", "author"):
        for s in question.get(f"signals_{kind}", []):
            score += 12.0 * F.contains(text, F.lit(s)).cast("int")
    return score + 20.0 * len(question.get("signals_gap", []))


def hybrid(semantic: Column, keyword: Column) -> Column:
    return 0.7 * semantic + 0.3 * F.least(keyword / 100, F.lit(1.0))


def boosted(sections: DataFrame, intent: str) -> DataFrame:
    """sections whose score is raised by 0.25, to 1 at most, where the intent prefers their label or source."""
    _, labels, sources = STRATEGIES.get(intent, STRATEGIES["general_research_question"])
    hit = F.lit(False)
    hit = hit | F.col("label").isin(*labels) if labels else hit
    hit = hit | F.col("source").isin(*sources) if sources else hit
    return sections.withColumn("score", F.when(hit, F.least(F.col("score") + 0.25, F.lit(1.0))).otherwise(F.col("score")))


def within_budget(sections: DataFrame, by: list[str], budget: int, order: list[Column], content: str | None = None) -> DataFrame:
    """Greedily by order: a section that no longer fits is skipped, later ones may still fit. What is left of a budget depends on
    every earlier section of its group, so a group's sections stream through its task in order; nothing is gathered. For groups that are
    small by what makes them (the sections found for a question); budget.within_budget_split() spreads a group over tasks.

    content: a text column. With it a group whose first section is larger than the whole budget has that one cut to the budget,
    and later ones still fit as if it weren't there."""
    import pyarrow as pa

    ship(sections.sparkSession)
    numbered = sections.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).sortWithinPartitions(*by, "_k")
    at, size = [numbered.columns.index(c) for c in by], numbered.columns.index("char_count")
    text = numbered.columns.index(content) if content else None

    def run(batches):
        group, free, any_yet = None, budget, False
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in at), strict=True))
            fits, cut = [], []
            for row, (key, n) in enumerate(zip(keys, batch.column(size).to_pylist(), strict=True)):
                if key != group:
                    group, free, any_yet = key, budget, False
                whole = n is not None and n <= free
                if text is not None and n is not None and not whole and not any_yet:
                    cut.append(row)
                fits.append(whole or bool(cut and cut[-1] == row))
                free -= n if whole else 0
                any_yet |= fits[-1]
            if cut:
                columns = list(batch.columns)
                texts, sizes = columns[text].to_pylist(), columns[size].to_pylist()
                for row in cut:
                    texts[row] = (texts[row] or "")[:budget]
                    sizes[row] = len(texts[row])
                columns[text], columns[size] = pa.array(texts, columns[text].type), pa.array(sizes, columns[size].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch.filter(pa.array(fits, pa.bool_()))

    return numbered.mapInArrow(run, numbered.schema).drop("_k")


def artifact_budget(content: Column, cap: int | Column) -> Column:
    """A text cut to a cap at its last line break, if there is one."""
    cap = F.lit(cap)
    cut = F.substring(content, F.lit(1), cap)
    at = F.length(cut) - F.instr(F.reverse(cut), "\n")
    return F.when(F.length(content) <= cap, content).otherwise(F.when(F.instr(F.reverse(cut), "\n") > 0, F.substring(cut, F.lit(1), at)).otherwise(cut))


def compressed(sections: DataFrame, by: list[str], threshold: float = 0.60, other_source: bool = False) -> DataFrame:
    """Greedily by score (ties by pos): sections that overlap with a kept one of their label (and, if asked for, of another source)
    are dropped. A label of any size is decided stretch by stretch; see apart.py."""
    kind = F.col("source") if other_source else None
    return kept_apart(sections, [*by, "label"], word_set(F.col("content")), [F.desc("score"), F.col("pos"), *by, F.col("label")], threshold, kind)


def near_pairs(sections: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """by, a, b, overlap: pairs of sections of a group and label above the threshold. They meet by their rare words."""
    keys = [*by, "label"]
    sets = sections.select(*keys, F.col("pos").alias("at"), F.lit("").alias("kind"), word_set(F.col("content")).alias("words"))
    own = lambda n, w: sets.select(*by, F.col("at").alias(n), F.col("words").alias(w))
    met = overlapping(rare_first(sets, keys), None, keys, threshold, False).select(F.least("at", "other").alias("a"), F.greatest("at", "other").alias("b"))
    pairs = met.join(own("a", "_x"), "a").join(own("b", "_y").drop(*by), "b")
    return pairs.select(*by, "a", "b", (F.size(F.array_intersect("_x", "_y")) / F.least(F.size("_x"), F.size("_y"))).alias("overlap"))


# -- evidence -------------------------------------------------------------------------------------------------------------
def claims(sections: DataFrame, least: int = 15) -> DataFrame:
    """sections' other columns with line, claim, is_inference: lines of enough characters, without a leading [mark] or bullet."""
    lines = sections.select(*[c for c in sections.columns if c != "content"], F.posexplode(F.split("content", "\n")).alias("line", "_l"))
    clean = F.regexp_replace(F.regexp_replace(strip(F.col("_l")), r"^\[.*?\]\s*", ""), r"^[-•*]\s*", "")
    found = lines.where(F.length(strip(F.col("_l"))) >= least).withColumn("claim", clean).where(F.length("claim") >= least)
    return found.withColumn("is_inference", any_in(F.lower("claim"), HEDGES)).drop("_l")


def aggregated_evidence(sections: DataFrame, by: list[str], threshold: float = 0.55, least: int = 15) -> DataFrame:
    """by, claim, confidence, is_inference: claims in order (pos, line) that don't overlap with an earlier kept one."""
    rows = claims(sections, least).withColumn("_n", normalized_claim(F.col("claim"))).where(F.length("_n") >= least)
    ready = rows.select(*by, "pos", "line", "claim", "_n", F.least(F.col("score") / 100, F.lit(1.0)).alias("confidence"), "is_inference")
    return kept_apart(ready, by, word_set(F.col("_n")), [F.col("pos"), F.col("line"), *by], threshold).drop("_n")


def grouped_citations(mentions: DataFrame) -> DataFrame:
    """claim, papers: distinct supporting papers of each claim, sorted, joined by |."""
    return mentions.groupBy("claim").agg(F.array_join(F.sort_array(F.collect_set("paper_title")), "|").alias("papers"))


def title_mentions(claim_rows: DataFrame, titles: DataFrame, by: list[str], limit: int = 5) -> DataFrame:
    """by, claim, paper_title: up to so many titles (of the same group) that stand in a claim, the first by name. Claims and titles
    meet by their words, not all of a group's with all of the other's."""
    named = titles.select(*by, "paper_title", F.lower("paper_title").alias("term")).where("paper_title <> ''").distinct()
    texts = claim_rows.select(*by, "claim").distinct().select(*by, "claim", F.lower("claim").alias("text"), F.sha2(F.to_json(F.struct(*by, "claim")).cast("binary"), 256).alias("id"))
    hits = containment.contained(named.select(*by, "term"), texts.select(*by, "id", "text"), by)
    found = hits.join(named, [*by, "term"]).join(texts.select("id", "claim"), "id")
    return top_n(found.select(*by, "claim", "paper_title"), limit, [*by, "claim"], [F.col("paper_title")]).drop("rank")


def citation_found(title: Column, context: Column) -> Column:
    """Whether a title stands in a context: as it is, without (…), in the context without […], or by enough of its long words."""
    t, c = strip(F.lower(title)), F.lower(context)
    bare = strip(F.regexp_replace(t, r"\s*\([^)]*\)\s*", ""))
    cleared = F.regexp_replace(c, r"\[.*?\]\s*", "")
    long = F.regexp_extract_all(t, F.lit("([a-zA-Z0-9]{4,})"), F.lit(1))
    hits = F.size(F.filter(long, lambda w: F.contains(c, w)))
    enough = (F.size(long) > 0) & (hits >= F.greatest(F.lit(3), F.floor(F.size(long) / 2)))
    return F.coalesce((t != "") & (F.contains(c, t) | ((bare != "") & (F.contains(c, bare) | F.contains(cleared, bare))) | enough), F.lit(False))


#: Of a title's rarest long words, how many a text must have before it is counted in full.
RARE = 6


def token_matches(titles: DataFrame, index: DataFrame) -> DataFrame:
    """title, id: texts that hold enough of a title's long words (tokens, repeated ones counting as often), as part of their own.

    titles: title, tokens; index: id, word. Tokens are looked up among the texts' distinct words by their parts of four
    characters. Any text with enough tokens has RARE of the title's rarest, those without which too few are left; only texts that
    have these are counted in full, from the text's list of tokens and the title's.
    """
    weights = titles.where(F.size("tokens") > 0).select("title", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    weights = weights.groupBy("title", "n", "token").agg(F.count("*").alias("m")).withColumn("need", F.greatest(F.lit(3), F.floor(F.col("n") / 2))).where("n >= need")
    runs = index.select("id", F.explode(F.array_distinct(F.regexp_extract_all("word", F.lit("([a-z0-9]{4,})"), F.lit(1)))).alias("word"))
    counts = runs.groupBy("word").agg(F.count("*").alias("df"))
    asked = weights.select("token").distinct().select("token", containment.grams(F.col("token"), 4).alias("_h"))
    inside = containment.looked_up(asked, counts, [], ("gram",), 4).where(F.contains("word", "token"))
    held = stored(inside.join(runs, "word").select("id", "token").distinct())

    often = held.groupBy("token").agg(F.count("*").alias("df"))
    w = Window.partitionBy("title").orderBy("df", "token")
    seen = F.coalesce(F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ordered = weights.join(often, "token").withColumns({"before": seen, "all": F.sum("m").over(Window.partitionBy("title"))})
    asked_for = F.least(F.col("need"), F.lit(RARE))
    rare = ordered.where(F.col("before") < F.col("all") - F.col("need") + asked_for).select("title", "token", "m", asked_for.alias("asked"))
    candidates = rare.join(held, "token").groupBy("title", "id", "asked").agg(F.sum("m").alias("m")).where("m >= asked").select("title", "id")
    lists = held.groupBy("id").agg(F.collect_set("token").alias("held"))
    whole = weights.groupBy("title", "need").agg(F.collect_list(F.struct("token", "m")).alias("own"))
    both = candidates.join(lists, "id").join(whole, "title")
    common = F.map_from_arrays(F.col("own.token"), F.col("own.m"))
    hits = F.aggregate(F.array_intersect(F.col("own.token"), "held"), F.lit(0).cast("long"), lambda a, t: a + F.element_at(common, t))
    return both.where(hits >= F.col("need")).select("title", "id")


def citations(documents: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, doc_id, found: every document (doc_id, text) in which citation_found() finds an item's title (item_id, title), and a row
    with a null doc_id, not found, for an item that is in none.

    Neither titles nor documents pass through the driver or meet all of the others: equal titles are looked for once, by an index
    of the documents' words, which is read for whole titles, titles without (...), and long words. A null text counts as empty;
    repeated documents give a row each. The index stays in the shared folder.
    """
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text")).withColumn("id", F.unhex(F.md5(F.col("text").cast("binary"))))
    texts = keyed.select("id", "text").dropDuplicates(["id"])
    index = stored(containment.index_of(texts, []))
    named = items.select("item_id", strip(F.lower("title")).alias("title")).where("title <> ''")
    bare = strip(F.regexp_replace("title", r"\s*\([^)]*\)\s*", ""))
    titles = named.select("title").distinct().select("title", bare.alias("bare"), F.regexp_extract_all("title", F.lit("([a-z0-9]{4,})"), F.lit(1)).alias("tokens"))
    terms = titles.select(F.explode(F.array("title", "bare")).alias("term")).where("term <> ''").distinct()
    cleared = texts.where(F.contains("text", F.lit("["))).withColumn("text", F.regexp_replace("text", r"\[.*?\]\s*", ""))
    whole = containment.contained(terms, texts, index=index)
    parts = whole.unionByName(containment.contained(titles.select(F.col("bare").alias("term")).where("term <> ''").distinct(), cleared))
    found = whole.select(F.col("term").alias("title"), "id").unionByName(titles.select("title", F.col("bare").alias("term")).join(parts, "term").select("title", "id"))
    pairs = found.unionByName(token_matches(titles, index)).distinct().join(keyed.select("id", "doc_id"), "id")
    cited = named.join(pairs.select("title", "doc_id"), "title").select(F.col("item_id").alias("_item"), "doc_id", F.lit(True).alias("_found"))
    return items.select("item_id").join(cited, F.col("item_id") == F.col("_item"), "left").select("item_id", "doc_id", F.coalesce("_found", F.lit(False)).alias("found"))


def confidence(positive: Column, total: Column, chars: Column, max_chars: int, examined: Column, kept: Column, mean_score: Column, model: Column) -> Column:
    """0 to 1 from the share of useful sections, context size, checked citations, scores and the model's own confidence; 0.1 without sections."""
    ratio = F.when(examined > 0, kept / examined).otherwise(1.0)
    score = 0.25 * positive / total + 0.10 * F.least(chars / max_chars, F.lit(1.0)) + 0.15 * ratio + 0.05 * kept / (kept + 3) + 0.15 * F.least(mean_score / 100, F.lit(1.0)) + 0.30 * F.greatest(F.least(model, F.lit(1.0)), F.lit(0.0))
    return F.when(total > 0, F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 2)).otherwise(0.1)


def confidence_reasons(positive: Column, total: Column, kept: Column, completeness: Column, coverage: Column, mean_score: Column) -> Column:
    parts = [
        F.when(total > 0, F.format_string("supported by %d/%d sections", positive, total)), F.when(kept > 0, F.format_string("%d validated citation(s)", kept)), F.when(completeness > 0.5, F.lit("substantial context coverage")),
        F.when(coverage > 0.5, F.lit("high evidence coverage")), F.when(mean_score > 30, F.lit("consistent retrieval scores")),
    ]
    text = F.array_join(F.array_compact(F.array(*parts)), "; ")
    return F.when(total == 0, "No retrieved sections available.").otherwise(F.when(text == "", "limited evidence").otherwise(text))


def history(messages: DataFrame, by: str, order: str, limit: int = 2000) -> DataFrame:
    """by, history: a conversation's messages in order as "Role: text" lines, each text cut to so many characters."""
    line = F.concat(F.initcap("role"), F.lit(": "), F.substring("text", 1, limit))
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return messages.groupBy(by).agg(F.array_join(F.transform(rows, lambda r: r["l"]), "\n").alias("history"))
