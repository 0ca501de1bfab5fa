"""Greedy removal in order against the walk that defines it."""

import random

import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import apart, retrieval

from .conftest import rows


def walk(data, threshold, across):
    """(group, source, id, text) in order: ids that are kept."""
    kept, out = {}, []
    for g, source, i, text in data:
        t = frozenset((text or "").lower().split())
        near = any(t and k and len(t & k) / min(len(t), len(k)) > threshold and (not across or s != source) for k, s in kept.get(g, []))
        if not near:
            kept.setdefault(g, []).append((t, source))
            out.append(i)
    return sorted(out)


def table(rng, n):
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choices(words, weights=range(60, 0, -1), k=rng.randint(0, 14))) for _ in range(n)]
    texts += [t + " extra" for t in texts[:30]] + texts[:25] + [None, "", " ", "W1 w2"] + ["hub a b c d e f " + x for x in rng.choices(words, k=80)]
    return [(rng.choice([1, 1, 1, 2, None]), rng.choice("xyz"), k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("threshold,across,first,most", [(0.6, False, 20_000, 10**7), (0.6, False, 37, 2000), (0.3, False, 50, 10**7), (0.65, True, 41, 3000), (0.5, True, 20_000, 10**7)])
def test_kept_apart(spark, threshold, across, first, most):
    data = table(random.Random(int(threshold * 100) + first), 150)
    df = spark.createDataFrame(data, "g long, source string, id long, text string").repartition(4)
    got = apart.kept_apart(df, ["g"], apart.word_set(F.col("text")), [F.col("id")], threshold, F.col("source") if across else None, first, most)
    assert got.columns == df.columns and sorted(r.id for r in got.collect()) == walk(data, threshold, across)
    assert apart.kept_apart(df.limit(0), ["g"], apart.word_set(F.col("text")), [F.col("id")], threshold).collect() == []


def test_compressed_and_evidence_walk_in_order(spark):
    rng = random.Random(3)
    data = [(q, s, "L1" if k % 3 else "L2", k, t, float(k * 7 % 5)) for k, (q, s, _, t) in enumerate(table(rng, 60))]
    sections = spark.createDataFrame(data, "q long, source string, label string, pos long, content string, score double")
    ordered = sorted(data, key=lambda r: (-r[5], r[3]))
    assert sorted(r.pos for r in retrieval.compressed(sections, ["q"]).collect()) == walk([((r[0], r[2]), r[1], r[3], r[4]) for r in ordered], 0.6, False)
    assert sorted(r.pos for r in retrieval.compressed(sections, ["q"], 0.65, other_source=True).collect()) == walk([((r[0], r[2]), r[1], r[3], r[4]) for r in ordered], 0.65, True)
    claims = spark.createDataFrame([(1, k, f"{a} claim about {b} and its {c}\n- short\n[x] {c} claim about {b} and its {a}", 60.0) for k, (a, b, c) in enumerate([rng.choices(["alpha", "beta", "gamma", "delta"], k=3) for _ in range(40)])], "q long, pos long, content string, score double")
    out = retrieval.aggregated_evidence(claims, ["q"])
    lines = [(1, "", (r.pos, r.line), r._n) for r in sorted(retrieval.claims(claims).withColumn("_n", retrieval.normalized_claim(F.col("claim"))).collect(), key=lambda r: (r.pos, r.line)) if len(r._n) >= 15]
    assert [(r.pos, r.line) for r in out.orderBy("pos", "line").collect()] == walk(lines, 0.55, False)


def test_a_group_of_near_copies(spark):
    """Rows that are all alike in one group: stretches are halved, and pairs stay far below the square."""
    df = spark.range(1500).select(F.lit(1).alias("g"), F.col("id"), F.concat(F.lit("the very same words again and again of passage number "), F.col("id").cast("string")).alias("text"))
    got = apart.kept_apart(df, ["g"], apart.word_set(F.col("text")), [F.col("id")], 0.6, first=1000, most=50_000).collect()
    assert [r.id for r in got] == [0]
