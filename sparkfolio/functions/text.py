"""Scalar normalisation of names, titles, URLs and terms, as Column expressions inside code generation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..shipping import ship

STRIP = r"^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, STRIP, "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def normalized_title(c: Column) -> Column:
    return squeeze(F.regexp_replace(strip(F.lower(c)), r"[^a-z0-9\s]", ""))


def normalized_claim(c: Column) -> Column:
    return F.regexp_replace(strip(F.lower(c)), r"[^a-z0-9\s]", "")


def normalized_url(c: Column) -> Column:
    """Null for a null or empty URL; else lower case, without scheme and final slashes."""
    clean = F.regexp_replace(F.regexp_replace(strip(F.lower(c)), r"^https?://", ""), r"/+$", "")
    return F.when(c != "", clean)


def external_ids(**namespaces: Column) -> Column:
    """array<struct<namespace, id>> of those that are there, lower case and stripped."""
    items = [F.when(F.coalesce(c, F.lit("")) != "", F.struct(F.lit(n).alias("namespace"), strip(F.lower(c)).alias("id"))) for n, c in namespaces.items()]
    return F.array_compact(F.array(*items))


def doi_from_url(c: Column) -> Column:
    """What follows the first "/doi.org/"; null without it."""
    return F.get(F.split(c, "/doi\\.org/", 2), F.lit(1))


def abstract_from_index(index: Column) -> Column:
    """Text of an inverted index map<word, array<position>>: words at their positions, the last word of an entry order wins, gaps stay empty."""
    once = lambda x, made: F.get(F.transform(F.array(x), made), F.lit(0))  # noqa: E731  x is computed once, however often it is named
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    ordered = F.sort_array(F.transform(pairs, lambda x, i: F.struct(x["p"].alias("p"), i.alias("i"), x["w"].alias("w"))))  # array_sort() calls a lambda a comparison
    at = lambda o, i: F.get(o, i)["p"]
    last = once(ordered, lambda o: F.filter(o, lambda x, i: at(o, i + 1).isNull() | (at(o, i + 1) != x["p"])))
    words = once(last, lambda o: F.transform(o, lambda x, i: F.concat(F.repeat(F.lit(" "), x["p"] - F.coalesce(at(o, i - 1), F.lit(-1)) - 1), x["w"])))
    return F.when(F.exists(F.map_values(index), lambda p: F.size(p) > 0), strip(F.array_join(words, " ")))


def inverted_index(texts: DataFrame, id_column: str, content: str) -> DataFrame:
    """id_column, index map<word, array<position>> of texts with a word, a row each: words are what stands between spaces, tabs and line
    breaks. Each row makes its own index, in Arrow batches; nothing is shuffled."""
    ship(texts.sparkSession)
    kind = texts.schema[id_column].dataType
    ids = to_arrow_type(kind)

    def run(batches):
        for batch in batches:
            kept, entries, words, counts, places = [], [0], [], [0], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                index: dict[str, list[int]] = {}
                for at, w in enumerate(x for x in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if x):
                    index.setdefault(w, []).append(at)
                if index:
                    kept.append(row)
                    words += index
                    for p in index.values():
                        places += p
                        counts.append(len(places))
                    entries.append(len(words))
            lists = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(places, pa.int32()))
            maps = pa.MapArray.from_arrays(pa.array(entries, pa.int32()), pa.array(words, pa.string()), lists)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())).cast(ids), maps], names=[id_column, "index"])

    return texts.select(id_column, content).where(F.col(content).rlike(r"[^ \t\n]")).mapInArrow(run, f"{id_column} {kind.simpleString()}, index map<string, array<int>>")


#: Endings that the light stemmer takes off the end of a phrase.
STEM = r"(ing|tion|ions|s|es|ed|ment|ments|al)$"


def normalized_term(c: Column) -> Column:
    """Space squeezed, punctuation but hyphens to spaces, lower case, light stem of the whole phrase. May give an empty string."""
    plain = F.regexp_replace(squeeze(c), r"[^\w\s-]", " ")
    return strip(F.regexp_replace(strip(F.lower(plain)), STEM, ""))


def normalized_author(c: Column) -> Column:
    """"Last, First" becomes "First Last"."""
    parts = F.split(squeeze(c), r"\s*,\s*", 2)
    return F.when(c.contains(","), strip(F.concat_ws(" ", F.get(parts, F.lit(1)), F.get(parts, F.lit(0))))).otherwise(squeeze(c))


def tokens(c: Column) -> Column:
    """Distinct lower-case tokens between white space."""
    return F.array_distinct(F.filter(F.split(strip(F.lower(c)), r"\s+"), lambda t: t != ""))


def content_overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of token sets; 0 if either is empty."""
    x, y = tokens(a), tokens(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))


def first_names(items: Column, n: int = 15) -> Column:
    return F.slice(F.transform(items, lambda x: x["name"]), 1, n)


def retrieval_key(question: Column) -> Column:
    return F.substring(F.sha2(question.cast("binary"), 256), 1, 16)


def summary(findings: Column) -> Column:
    return F.array_join(F.slice(findings, 1, 3), " ")


# Substrings, tried in this order, by which institutions and technologies are classified.
INSTITUTION_KINDS = {
    "university": ["university", "college", "institute of technology", "eth", "mit", "caltech"],
    "lab": ["lab", "laboratory", "research center", "research centre"],
    "company": ["google", "microsoft", "meta", "amazon", "apple", "nvidia", "ibm", "openai", "inc", "corp", "ltd", "anthropic", "deepmind"],
    "government": ["government", "national", "department of", "ministry", "agency"],
}
TECHNOLOGY_KINDS = {
    "framework": ["pytorch", "tensorflow", "jax", "keras", "django", "flask", "react", "angular", "spring"],
    "library": ["lib", "library", "numpy", "scipy", "sklearn", "opencv", "pandas"],
    "tool": ["cuda", "docker", "kubernetes", "git", "nginx", "redis"],
}


def kind_of(name: Column, kinds: dict[str, list[str]], word_boundary: bool = False) -> Column:
    """The first kind one of whose words occurs in the name; "other" without. word_boundary asks for whole words."""
    out, lower = None, F.lower(name)
    for kind, words in kinds.items():
        pattern = "|".join(words)
        hit = lower.rlike(rf"\b(?:{pattern})\b" if word_boundary else pattern)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("other")


def kind_sql(column: str, kinds: dict[str, list[str]]) -> str:
    cases = " ".join(f"WHEN regexp_matches(lower({column}), '{'|'.join(words)}') THEN '{kind}'" for kind, words in kinds.items())
    return f"CASE {cases} ELSE 'other' END"


#: Names that stand for nothing.
PLACEHOLDERS = "to be determined|tbd|n/a|na|unknown|none|not specified|not available|not applicable|todo|placeholder|unclear|not mentioned"


def is_entity_name(c: Column) -> Column:
    """2 to 200 characters once stripped; not one punctuation mark, a number, special characters alone, or a placeholder."""
    s = strip(c)
    n = F.length(s)
    bad = s.rlike(r"^[.,;:!?\-]$") | s.rlike(r"^\d+[.\d]*$") | s.rlike(r"^[^a-zA-Z0-9]+$") | F.lower(s).rlike(f"^({PLACEHOLDERS})$")
    return F.coalesce((n >= 2) & (n <= 200) & ~bad, F.lit(False))


def valid_entities(items: Column, kind: str, least: float = 0.3) -> Column:
    """Of an array of names those that name an entity, as structs of name and confidence; below the least confidence they are left out."""
    scored = F.transform(items, lambda x: F.struct(x.alias("name"), entity_confidence(F.lit(kind), x, F.lit(False)).alias("confidence")))
    return F.filter(scored, lambda e: is_entity_name(e["name"]) & (e["confidence"] >= least))


def entity_confidence(kind: Column, name: Column, has_extra: Column) -> Column:
    """0 for an invalid name, else 0.5 with bonuses for length, form and extra fields; at most 1, two decimals."""
    s = strip(name)
    n = F.length(s)
    upper_later = F.substring(name, 2, 1 << 30).rlike(r"\p{Lu}")
    extra = (
        F.when(n >= 10, 0.2).when(n >= 5, 0.1).otherwise(0.0)
        + F.when((kind == "author") & s.contains(" "), 0.15).otherwise(0.0)
        + F.when((kind == "author") & (F.size(F.split(s, r"\s+")) >= 2), 0.05).otherwise(0.0)
        + F.when((kind == "institution") & F.lower(name).rlike("university|institute|college|lab|school"), 0.15).otherwise(0.0)
        + F.when(kind == "institution", 0.05).otherwise(0.0)
        + F.when(kind.isin("dataset", "technology") & upper_later, 0.1).otherwise(0.0)
        + F.when(has_extra, 0.1).otherwise(0.0)
    )
    return F.when(is_entity_name(name), F.round(F.least(F.lit(0.5) + extra, F.lit(1.0)), 2)).otherwise(0.0)
