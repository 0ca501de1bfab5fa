"""What an answer is made from and followed by: contexts of artifacts, retrieval with a fallback, prompts, answers, follow-up questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json_repair import repair_json
from ..functions.text import strip
from ..shipping import ship
from .retrieval import artifact_budget
from .sinks import latest_ready

# Artifacts in the order in which they get a share of the context, characters of each, and of all.
BUDGETS = {"knowledge_package": 8000, "research_gap_report": 5000, "research_landscape": 4000, "paper_collection": 6000, "validated_collection": 3000}
CONTEXT_CHARS = 28_000
CUT_NOTE = "[Context truncated due to length]"


def artifact_context(artifacts: DataFrame, by: str = "investigation_id", budgets: dict[str, int] | None = None, total: int = CONTEXT_CHARS) -> DataFrame:
    """by, position, artifact_type, content: of each group the newest ready artifact of each type, cut to its share and to what is left.

    artifacts: id, by, artifact_type, status, created_at, payload (a text). A group has at most one of each of a few types, so
    its fold runs in the JVM over an array of that length. What no longer fits is left out.
    """
    budgets = budgets or BUDGETS
    table = artifacts.sparkSession.createDataFrame([(t, k, n) for k, (t, n) in enumerate(budgets.items(), 1)], "artifact_type string, position int, share int")
    newest = latest_ready(artifacts, [by, "artifact_type"]).join(F.broadcast(table), "artifact_type")  # a row a type
    parts = newest.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("position", "artifact_type", "share", "payload"))).alias("_p"))
    made = "array<struct<position:int,artifact_type:string,content:string>>"

    def step(acc: Column, x: Column) -> Column:
        content = artifact_budget(x["payload"], F.least(x["share"], acc["left"]))
        one = F.struct(x["position"].alias("position"), x["artifact_type"].alias("artifact_type"), content.alias("content"))
        return F.when(acc["left"] <= 0, acc).otherwise(F.struct((acc["left"] - F.length(content)).cast("int").alias("left"), F.array_append(acc["out"], one).alias("out")))

    start = F.struct(F.lit(total).cast("int").alias("left"), F.array().cast(made).alias("out"))
    return parts.select(by, F.explode(F.aggregate("_p", start, step)["out"]).alias("x")).select(by, "x.*")


def context_text(sections: DataFrame, by: str = "investigation_id", total: int = CONTEXT_CHARS) -> DataFrame:
    """by, context: sections of artifact_context() under headings, with a note if they take the whole budget."""
    label = F.initcap(F.replace("artifact_type", F.lit("_"), F.lit(" ")))
    block = F.concat(F.lit("=== "), label, F.lit(" ===\n"), F.col("content"))
    rows = sections.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("position", block.alias("b")))).alias("_r"), F.sum(F.length("content")).alias("_n"))
    text = F.array_join(F.transform("_r", lambda r: r["b"]), "\n\n")
    return rows.select(by, F.when(F.col("_n") >= total, F.concat(text, F.lit("\n" + CUT_NOTE))).otherwise(text).alias("context"))


def paper_context(papers: DataFrame, by: str, limit: int = 15, abstract: int = 400) -> DataFrame:
    """by, context: the first papers (by pos) of a group as blocks of title, authors, the abstract's beginning and DOI."""
    w = Window.partitionBy(by).orderBy("pos")
    first = papers.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= limit)
    no = lambda c, other: F.when(F.coalesce(c, F.lit("")) == "", other).otherwise(c)
    block = F.concat(
        F.lit("Title: "), F.coalesce("title", F.lit("None")), F.lit("\nAuthors: "), F.coalesce(F.array_join("authors", ", "), F.lit("")), F.lit("\nAbstract: "), F.coalesce(F.substring("abstract", 1, abstract), F.lit("")),
        F.lit("\nDOI: "), no(F.col("doi"), F.lit("N/A")),
    )
    rows = first.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("_k", block.alias("b")))).alias("_r"))
    return rows.select(by, F.array_join(F.transform("_r", lambda r: r["b"]), "\n\n").alias("context"))


def with_fallback(semantic: DataFrame, keyword: DataFrame, by: list[str]) -> DataFrame:
    """semantic's rows, and keyword's for the groups of which semantic has none, with retriever: which of the two a row is from."""
    there = semantic.select(*by).distinct()
    rest = keyword.join(there, by, "left_anti") if by else keyword.join(F.broadcast(semantic.limit(1).select(F.lit(1).alias("_any"))), F.lit(True), "left_anti")
    return semantic.withColumn("retriever", F.lit("semantic")).unionByName(rest.select(*semantic.columns).withColumn("retriever", F.lit("heuristic")))


# -- prompts and answers --------------------------------------------------------------------------------------------------
INSTRUCTIONS = """You answer questions about one research investigation, from its context alone.
Say what is observed, then what follows from it, then a conclusion. Mark what is inferred. Cite papers by title, grouped by claim.
If the context doesn't tell, say so. Answer with one JSON object: answer, evidence, citations, grouped_citations, confidence (0 to 1), confidence_explanation, reasoning, suggested_questions."""
NOTHING = "No relevant investigation sections found."
GAPS_ASKED = "The question is about research gaps: name what is missing, why it matters and who has come closest."


def prompts(questions: DataFrame, sections: DataFrame, history: DataFrame | None = None, evidence: DataFrame | None = None, by: str = "question_id", limit: int = 15) -> DataFrame:
    """by, system, user: prompts for questions (by, text, intent) of retrieved sections (by, source, label, content, score, pos),
    a conversation so far (by, history) and evidence (by, position, claim, papers, confidence, is_inference), of which the first
    fifteen are summed up. A question without sections is told so."""
    block = F.concat(F.lit("["), "source", F.lit(" / "), "label", F.lit("]\n"), "content")
    ordered = lambda df, k, what: df.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(k.alias("k"), what.alias("b")))).alias("_r"))
    joined = lambda sep: F.array_join(F.transform("_r", lambda r: r["b"]), sep)
    w = Window.partitionBy(by).orderBy(F.desc("score"), "pos")
    first = sections.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= limit)
    df = questions.join(ordered(first, F.col("_k"), block).select(by, joined("\n\n").alias("_context")), by, "left")
    df = df.join(history.select(by, F.col("history").alias("_history")), by, "left") if history is not None else df.withColumn("_history", F.lit(None).cast("string"))
    if evidence is not None:
        n = F.row_number().over(Window.partitionBy(by).orderBy("position"))
        cited = F.array_join(F.slice("papers", 1, 3), ", ")
        line = F.concat(
            F.col("_n").cast("string"), F.when(F.col("is_inference"), ". [INFERENCE] ").otherwise(". [EVIDENCE] "), F.col("claim"), F.when(cited != "", F.concat(F.lit(" — Papers: "), cited)).otherwise(""),
            F.when(F.col("confidence") > 0, F.format_string(" (confidence: %.2f)", F.col("confidence"))).otherwise(""),
        )
        summed = ordered(evidence.withColumn("_n", n).where(F.col("_n") <= 15), F.col("_n"), line).select(by, joined("\n").alias("_evidence"))
        df = df.join(summed, by, "left")
    else:
        df = df.withColumn("_evidence", F.lit(None).cast("string"))
    part = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"## {title}\n\n"), c))
    system = F.concat_ws(
        "\n\n", F.lit(INSTRUCTIONS), F.when(F.col("intent") == "research_gap_exploration", F.lit(GAPS_ASKED)), part("Evidence Summary", F.col("_evidence")), part("Context", F.coalesce("_context", F.lit(NOTHING))),
        part("Previous Conversation", F.col("_history")), part("Question", F.col("text")),
    )
    user = F.concat(F.when(F.coalesce("_history", F.lit("")) != "", F.concat(F.lit("Previous conversation:\n"), F.col("_history"), F.lit("\n\n"))).otherwise(""), F.lit("Question: "), F.col("text"))
    return df.select(by, system.alias("system"), user.alias("user"))


ANSWER = """answer string, evidence array<string>, citations array<struct<paper_title:string,relevance:string>>,
    grouped_citations array<struct<claim:string,papers:array<struct<paper_title:string,relevance:string>>>>, confidence double, confidence_explanation string, reasoning string, suggested_questions array<string>"""


def answers(df: DataFrame, raw: str) -> DataFrame:
    """df with the fields of ANSWER read from a model's raw text, repaired if need be; missing ones are empty, a text without
    JSON is the answer itself. confidence is held within 0 and 1, and 0.5 if it is missing."""
    parsed = df.withColumn("_json", repair_json(F.col(raw))).withColumn("_a", F.from_json("_json", ANSWER))
    a = F.col("_a")
    words = lambda name: F.coalesce(a[name], F.lit(""))
    listed = lambda name, kind: F.coalesce(a[name], F.array().cast(f"array<{kind}>"))
    cited = "struct<paper_title:string,relevance:string>"
    return parsed.withColumns(
        {
            "answer": F.coalesce(a["answer"], F.when(F.col("_json").isNull(), strip(F.col(raw))), F.lit("")), "evidence": listed("evidence", "string"), "citations": listed("citations", cited),
            "grouped_citations": listed("grouped_citations", f"struct<claim:string,papers:array<{cited}>>"), "confidence": F.least(F.greatest(F.coalesce(a["confidence"], F.lit(0.5)), F.lit(0.0)), F.lit(1.0)),
            "confidence_explanation": words("confidence_explanation"), "reasoning": words("reasoning"), "suggested_questions": listed("suggested_questions", "string"),
        }
    ).drop("_json", "_a")


def generated(df: DataFrame, prompt: str, client: Callable[[], Callable[[str], str]], out: str = "generated") -> DataFrame:
    """df with what a language model makes of the column prompt. client() is called once in each task and gives a function of a
    prompt; nothing here calls a service. A prompt that fails gives a null."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = client()

        def one(text):
            try:
                return ask(text)
            except Exception:  # a client from outside may fail in any way
                return None

        for s in batches:
            yield s.map(one)

    return df.withColumn(out, run(F.col(prompt)))


# -- follow-up questions --------------------------------------------------------------------------------------------------
# How questions begin by the label of a section and by what evidence speaks of, and questions that always fit.
LABEL_QUESTIONS = {
    "methodologies": "What methodologies", "technologies": "What technologies", "datasets": "What datasets", "evaluation metrics": "What evaluation metrics", "research gaps": "What research gaps",
    "limitations": "What limitations", "future work": "What future work directions", "research questions": "What open research questions", "recommendations": "What recommendations", "applications": "What applications", "key findings": "What are the key findings",
}
EVIDENCE_QUESTIONS = [
    ("methodolog", "How do the methodologies compare"), ("dataset", "Which datasets are most commonly used"), ("limit", "What are the main limitations shared across studies"),
    ("future", "What future research directions are suggested"), ("gap", "What research gaps remain unexplored"),
]
ALWAYS = [
    ("Can you summarise the key findings?", "finding", "key findings"), ("What conclusions can be drawn from this investigation?", None, None), ("How do the methodologies compare across the reviewed papers?", "methodolog", "methodologies"),
    ("What are the main research challenges identified?", "challenge", "limitations"), ("What recommendations are suggested for future work?", "recommendation", "recommendations"),
    ("How were the datasets used in the reviewed studies?", "dataset", "datasets"), ("What technologies were employed in this research?", "technolog", "technologies"),
]


def topics(content: Column, n: int = 3) -> Column:
    """What the first lines of a text are about: without [mark] or bullet, up to a colon, of more than five characters, 80 at most."""
    bare = F.transform(F.split(content, "\n"), lambda x: F.regexp_replace(F.regexp_replace(strip(x), r"^\[.*?\]\s*", ""), r"^[-•*]\s*", ""))
    head = F.transform(bare, lambda x: strip(F.substring(F.when(F.instr(x, ":") > 1, F.substring_index(x, ":", 1)).otherwise(x), 1, 80)))
    return F.slice(F.filter(head, lambda x: F.length(x) > 5), 1, n)


def follow_ups(questions: DataFrame, sections: DataFrame, claims: DataFrame, by: str = "question_id", limit: int = 5) -> DataFrame:
    """by, position, text: up to so many questions to go on with, each once however it is spelt.

    First those that a section's label (sections: by, pos, label, content) suggests, about its topics; then those on what the
    evidence (claims: by, claim) speaks of; then general ones that fit the labels, or the first three of these.
    """
    about = F.array_join(F.slice(topics(F.col("content")), 1, 2), ", ")
    begin = F.create_map(*[F.lit(x) for pair in LABEL_QUESTIONS.items() for x in pair])[strip(F.lower("label"))]
    text = F.when(about != "", F.concat(begin, F.lit(" are most relevant to "), about, F.lit("?"))).otherwise(F.concat(begin, F.lit(" are used in this research area?")))
    row = lambda df, phase, at, text: df.select(by, F.lit(phase).alias("_phase"), at.cast("long").alias("_at"), text.alias("text"))
    of_labels = row(sections, 0, F.col("pos"), text).where("text is not null")
    spoken = claims.groupBy(by).agg(*[F.max(F.contains(F.lower("claim"), F.lit(w))).alias(f"_{k}") for k, (w, _) in enumerate(EVIDENCE_QUESTIONS)])
    hits = F.array(*[F.when(F.col(f"_{k}"), F.struct(F.lit(k).alias("k"), F.lit(f"{q} in these studies?").alias("q"))) for k, (_, q) in enumerate(EVIDENCE_QUESTIONS)])
    of_claims = row(spoken.select(by, F.explode(F.array_compact(hits)).alias("x")), 1, F.col("x.k"), F.col("x.q"))
    labels = sections.groupBy(by).agg(F.collect_set(strip(F.lower("label"))).alias("_labels"))
    known = questions.select(by).distinct().join(labels, by, "left")
    asked = F.array_compact(F.array(*[F.when(F.array_contains("_labels", label), F.struct(F.lit(k).alias("k"), F.lit(q).alias("q"))) for k, (q, _, label) in enumerate(ALWAYS) if label]))
    plain = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(q).alias("q")) for k, (q, *_) in enumerate(ALWAYS[:3])])
    always = row(known.select(by, F.explode(F.when(F.coalesce(F.size(asked), F.lit(0)) > 0, asked).otherwise(plain)).alias("x")), 2, F.col("x.k"), F.col("x.q"))
    every = of_labels.unionByName(of_claims).unionByName(always)
    once = every.groupBy(by, F.regexp_replace(F.lower("text"), "[^a-z0-9]", "").alias("_norm")).agg(F.min(F.struct("_phase", "_at", "text")).alias("x"))
    w = Window.partitionBy(by).orderBy("x")  # a handful of labels, topics and fixed questions
    return once.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") <= limit).select(by, "position", F.col("x.text").alias("text"))
