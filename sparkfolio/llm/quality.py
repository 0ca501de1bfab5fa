"""Quality rules: fixed base rules and thresholds adapted to each language and source. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, table

SPACE, NOT_SPACE, SYMBOLS = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]", r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: metric: (what is summed up, per what, resolution, least distance from the median that is ever rejected, whether low values are)
METRICS = {
    "word_length": ("word_chars", "n_words", 100, 80, True),
    "symbols": ("n_symbols", "n_words", 1000, 100, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 500, False),
    "stutter": ("n_stutter", "n_words", 1000, 200, False),
}
#: A value is rejected farther from the median than so many interquartile ranges.
FENCE = 4
#: A group's quartiles are averaged with its language's, which count as so many documents, and a language's with everyone's.
PRIOR = 100


def with_features(docs: DataFrame, repeats: bool = True) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_stutter (words equal to the one before) and, if asked
    for, n_repeat_words and base_failed.

    A null text has no words. Columns of these names that docs has are replaced. The features come out of a generator of one
    row, so that no filter on them is pushed down with all that they are made of written out again and again.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_stutter", *(["n_repeat_words", "base_failed"] if repeats else [])]
    own = [c for c in docs.columns if c not in made]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    n = F.size("_words") - 1
    pairs = F.zip_with(F.slice("_words", F.lit(1), n), F.slice("_words", F.lit(2), n), lambda a, b: a == b)
    df = docs.withColumns({"_words": words, "_lines": lines}).withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_stutter": F.when(n > 0, F.size(F.filter(pairs, lambda same: same))).otherwise(0).cast("long"),
        }
    )
    if repeats:
        df = with_repeats(df)
        failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
        df = df.withColumn("base_failed", failed)
    one = F.explode(F.array(F.struct(*made)))
    return df.select(*[F.col(f"`{c}`") for c in own], one.alias("_f")).select(*[F.col(f"`{c}`") for c in own], "_f.*")


def with_repeats(df: DataFrame) -> DataFrame:
    """n_repeat_words from _words: words in windows of 8 that occur at least twice. Windows are compared by 64-bit hashes."""

    def joined(name: str, shift: int) -> Column:
        """Hashes of stretches of twice the length from those of stretches of shift words."""
        n = F.size(name) - shift
        return F.when(n > 0, F.zip_with(F.slice(name, F.lit(1), n), F.slice(name, F.lit(shift + 1), n), lambda a, b: F.xxhash64(a, b)))

    df = df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    for shift in (1, 2, 4):
        df = df.withColumn("_h", joined("_h", shift))
    df = df.withColumn("_again", F.size(F.array_distinct("_h")) < F.size("_h"))
    ranked = F.when(F.col("_again"), F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("_ranked", ranked)
    n = F.size("_ranked")

    def same(k: Column, other: Column) -> Column:
        return F.get("_ranked", k)["h"] == F.get("_ranked", other)["h"]

    twice = F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
    starts = F.when(F.col("_again"), F.sort_array(F.transform(twice, lambda k: F.get("_ranked", k)["i"])))
    df = df.withColumn("_starts", starts)
    m = F.size("_starts") - 1
    steps = F.zip_with(F.slice("_starts", F.lit(2), m), F.slice("_starts", F.lit(1), m), lambda b, a: F.least(F.lit(WINDOW), b - a))
    covered = F.when(F.col("_again"), F.aggregate(steps, F.lit(WINDOW), lambda s, x: s + x)).otherwise(0)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_h", "_again", "_ranked", "_starts")


def metric(name: str) -> Column:
    """A metric as an integer at its resolution; null where it is undefined."""
    top, per, scale, _, _ = METRICS[name]
    return F.when(F.col(per) > 0, F.expr(f"({scale} * {top}) div {per}"))


def bucket(value: Column) -> Column:
    """The sketch's bucket: values below 1024 are exact, larger ones keep their ten leading bits (an error below 0.2 %)."""
    shift = F.greatest(F.length(F.bin(value)) - 10, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def group_keys() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in ("lang", "source")]


def thresholds(features: DataFrame) -> DataFrame:
    """_lang_of, _source_of and the bounds low_*, high_* of every metric, a row per language and source.

    The sketch of a group counts the rows of each bucket, so sketches merge by adding counts, in any order, to the same
    result; languages and the whole are merged from groups. Quartiles are the least bucket that reaches the share. Those
    of a group are averaged with its language's, PRIOR documents against its own number, those of a language likewise with
    the whole's: a small group leans on its language, and one document more never changes whose thresholds hold.
    """
    rows = features.where(F.col("n_words") >= MIN_WORDS).select(
        *group_keys(), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), metric(m).alias("value")) for m in METRICS])).alias("x")
    )
    sketch = cut(
        rows.where("x.value is not null").groupBy("_lang", "_source", F.col("x.metric").alias("metric"), bucket(F.col("x.value")).alias("bucket")).agg(F.count("*").alias("n"))
    )

    def quartiles(counts: DataFrame, keys: list[str], suffix: str) -> DataFrame:
        by = Window.partitionBy(*keys, "metric")
        upto = F.sum("n").over(by.orderBy("bucket"))
        all_ = F.sum("n").over(by)
        ranked = counts.withColumns({"upto": upto, "all": all_})
        return ranked.groupBy(*keys, "metric").agg(
            F.first("all").cast("double").alias(f"n{suffix}"), *[F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("bucket"))).cast("double").alias(f"q{k}{suffix}") for k in (1, 2, 3)]
        )

    fine = quartiles(sketch, ["_lang", "_source"], "")
    lang = quartiles(sketch.groupBy("_lang", "metric", "bucket").agg(F.sum("n").alias("n")), ["_lang"], "_lang")
    whole = quartiles(sketch.groupBy("metric", "bucket").agg(F.sum("n").alias("n")), [], "_all")

    def leaning(k: int, n: str, up: Column) -> Column:
        return (F.col(f"n{n}") * F.col(f"q{k}{n}") + PRIOR * up) / (F.col(f"n{n}") + PRIOR)

    joined = fine.join(lang, ["_lang", "metric"]).join(F.broadcast(whole), "metric")  # whole has a row for each metric
    q = joined.select("_lang", "_source", "metric", *[leaning(k, "", leaning(k, "_lang", F.col(f"q{k}_all"))).alias(f"q{k}") for k in (1, 2, 3)])
    out = []
    for m, (_, _, _, least, low) in METRICS.items():
        here = F.col("metric") == m
        width = F.greatest(F.lit(float(least)), FENCE * (F.col("q3") - F.col("q1")))
        out.append(F.max(F.when(here, F.col("q2") + width)).alias(f"high_{m}"))
        if low:
            out.append(F.max(F.when(here, F.col("q2") - width)).alias(f"low_{m}"))
    return q.groupBy(F.col("_lang").alias("_lang_of"), F.col("_source").alias("_source_of")).agg(*out)


def judged(features: DataFrame, limits: DataFrame) -> DataFrame:
    """features with kept: false if base_failed or a metric is outside its group's bounds. A group without bounds has no further rule.

    Bounds are a table, a row a group, so that the planner broadcasts it if its size allows it; else adaptive execution can
    split the rows of a group that has a third of all.
    """
    limits = table(limits)
    lang, source = group_keys()
    joined = features.withColumns({"_l": lang, "_s": source}).join(limits, (F.col("_l") == F.col("_lang_of")) & (F.col("_s") == F.col("_source_of")), "left")
    outside = F.lit(False)
    for m, (*_, low) in METRICS.items():
        outside |= F.coalesce(metric(m) > F.col(f"high_{m}"), F.lit(False))
        if low:
            outside |= F.coalesce(metric(m) < F.col(f"low_{m}"), F.lit(False))
    drop = ["_l", "_s", *limits.columns]
    return joined.withColumn("kept", ~F.col("base_failed") & ~outside).drop(*drop)


FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row of docs.

    A row without words (null, empty or blank text) fails the base rules. Null lang or source is a group of its own; repeated
    rows are judged each, a very long text as any other; an empty table gives an empty one. Other columns are not read.
    Texts are read once; what follows is on numbers.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    features = cut(with_features(slim).drop("text"))
    return judged(features, thresholds(features)).select("doc_id", *FEATURES, "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns (whatever these are called), that quality_verdicts() keeps; rows are as there.

    Texts are read twice rather than shuffled.
    """
    columns = docs.columns
    limits = thresholds(with_features(docs.select("text", "lang", "source"), repeats=False))
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), *[F.col(c) for c in ("text", "lang", "source")])
    return judged(with_features(plain), limits).where("kept").select("_row.*")


#: The same in SQL, over the view documents.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, row_number() OVER () AS r, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
windows AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
f AS (SELECT w.r, doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1]))::BIGINT AS n_stutter, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN covered ON covered.r = w.r),
g AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
        CASE WHEN n_words > 0 THEN (100 * word_chars) // n_words END AS word_length, CASE WHEN n_words > 0 THEN (1000 * n_symbols) // n_words END AS symbols,
        CASE WHEN n_lines > 0 THEN (1000 * n_dup_lines) // n_lines END AS dup_lines, CASE WHEN n_words > 0 THEN (1000 * n_stutter) // n_words END AS stutter FROM f),
long AS (SELECT lang, source, metric, value FROM (
    SELECT lang, source, unnest(['word_length', 'symbols', 'dup_lines', 'stutter']) AS metric, unnest([word_length, symbols, dup_lines, stutter]) AS value FROM g WHERE n_words >= {MIN_WORDS}) WHERE value IS NOT NULL),
sk AS (SELECT lang, source, metric, (value // (1 << greatest(length(ltrim(bin(value), '0')) - 10, 0))) * (1 << greatest(length(ltrim(bin(value), '0')) - 10, 0)) AS bucket FROM long),
lev AS (SELECT 0 AS lev, lang, source, metric, bucket FROM sk UNION ALL SELECT 1, lang, '', metric, bucket FROM sk UNION ALL SELECT 2, '', '', metric, bucket FROM sk),
c AS (SELECT lev, lang, source, metric, bucket, count(*) AS n FROM lev GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY lev, lang, source, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lev, lang, source, metric) AS total FROM c),
q AS (SELECT lev, lang, source, metric, max(total)::DOUBLE AS n, [min(bucket) FILTER (4 * upto >= total)::DOUBLE, min(bucket) FILTER (2 * upto >= total)::DOUBLE,
        min(bucket) FILTER (4 * upto >= 3 * total)::DOUBLE] AS q FROM u GROUP BY ALL),
m AS (SELECT x.lang, x.source, x.metric, list_transform([1, 2, 3], lambda k: (x.n * x.q[k] + {PRIOR}::DOUBLE * ((y.n * y.q[k] + {PRIOR}::DOUBLE * z.q[k]) / (y.n + {PRIOR}::DOUBLE))) / (x.n + {PRIOR}::DOUBLE)) AS q
      FROM q x JOIN q y ON y.lev = 1 AND y.lang = x.lang AND y.metric = x.metric JOIN q z ON z.lev = 2 AND z.metric = x.metric WHERE x.lev = 0),
t AS (SELECT lang, source, metric, q[2] - greatest(80.0::DOUBLE, {FENCE}::DOUBLE * (q[3] - q[1])) AS low,
        q[2] + greatest(CASE metric WHEN 'word_length' THEN 80 WHEN 'symbols' THEN 100 WHEN 'dup_lines' THEN 500 ELSE 200 END::DOUBLE, {FENCE}::DOUBLE * (q[3] - q[1])) AS high FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT coalesce(word_length > w1.high OR word_length < w1.low, false) AND NOT coalesce(symbols > w2.high, false) AND NOT coalesce(dup_lines > w3.high, false)
    AND NOT coalesce(stutter > w4.high, false) AS kept
FROM g LEFT JOIN t w1 ON w1.lang = g.lang AND w1.source = g.source AND w1.metric = 'word_length'
LEFT JOIN t w2 ON w2.lang = g.lang AND w2.source = g.source AND w2.metric = 'symbols'
LEFT JOIN t w3 ON w3.lang = g.lang AND w3.source = g.source AND w3.metric = 'dup_lines'
LEFT JOIN t w4 ON w4.lang = g.lang AND w4.source = g.source AND w4.metric = 'stutter'
"""
