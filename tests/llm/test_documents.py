"""Sharding, quality rules, fingerprints and near duplicates against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest

from sparkfolio.llm import fingerprints, neardup, quality, sharding
from sparkfolio.llm.components import components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def one_by_one(sizes, capacity):
    """Best fit decreasing as it is defined: (size, bin) of every item, and the bins' sums."""
    left, where = [], []
    for size in sorted(sizes, reverse=True):
        fit = [(free, k) for k, free in enumerate(left) if free >= size]
        k = min(fit)[1] if fit else len(left)
        left += [] if fit else [capacity]
        left[k] -= size
        where.append((size, k))
    return where, len(left)


def test_best_fit_takes_the_tightest_bin():
    rng = random.Random(2)
    for _ in range(300):
        sizes = [rng.choice((rng.randint(1, 50), 7, 3)) for _ in range(rng.randint(0, 40))]
        runs = sharding.best_fit_decreasing(sorted(Counter(sizes).items(), reverse=True), 40)
        where, n = one_by_one(sizes, 40)
        assert sorted((s, k) for s, _, count, k in runs for _ in range(count)) == sorted(where) and len({k for *_, k in runs}) == n
        for size in set(sizes):  # an item's rank among those of its size is in one run
            assert sorted(i for s, first, count, _ in runs if s == size for i in range(first, first + count)) == list(range(sizes.count(size)))


def test_least_capacity():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.randint(1, 90) for _ in range(rng.randint(1, 60))]
        runs = sharding.fewest_bytes(sorted(Counter(sizes).items(), reverse=True), 5)
        load = Counter()
        for s, _, n, k in runs:
            load[k] += s * n
        assert len(load) <= 5 and sum(load.values()) == sum(sizes) and max(load.values()) <= -(-sum(sizes) // 5) + max(sizes)


def test_sharding(spark):
    rng = random.Random(3)
    values = [(i, prose(rng, rng.randint(1, 60))) for i in range(700)] + [(1000 + i, "the same text") for i in range(40)] + [(2000, None), (2001, ""), (None, "x"), (3005, "again"), (3005, "again"), (4000, "long " * 300)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in values], "doc_id long, text string, shard long")
    out = sharding.shard_documents(docs, parts=4).toPandas()
    assert len(out) == len(values) and set(out.law) == {"bytes"} and out.grown_shard.isna().all() and out.shard.between(0, 23).all()
    assert (out.sort_values("slot").groupby("shard").slot.apply(list).map(lambda s: s == list(range(len(s))))).all()
    size = out.groupby("shard")["size"].sum()
    assert size.max() <= 1.02 * size.sum() / 24 and len(size) == 24
    text = dict((i, t) for i, t in values if i is not None)
    for r in out.dropna(subset=["doc_id"]).itertuples():
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    assert out[out.doc_id.between(1000, 1039)].shard.nunique() == 1 and out[out.doc_id.isin([2000, 2001])].shard.nunique() == 1
    groups = Counter()
    for _, t in values:
        groups[t or ""] += len((t or "").encode()) + 8
    want = Counter()
    for s, _, n, k in sharding.fewest_bytes(sorted(Counter(groups.values()).items(), reverse=True), 24):
        want[s, k] += n
    shard_of = {text[r.doc_id] or "": r.shard for r in out.dropna(subset=["doc_id"]).itertuples()}
    got = Counter((groups[t], k) for t, k in shard_of.items())
    assert sum((got - want).values()) == 0 and sum((want - got).values()) == 1  # the text without doc_id
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def quality_table():
    rng = random.Random(4)
    values = []
    for i in range(400):
        text = prose(rng, rng.randint(15, 80))
        if i % 20 == 0:
            text = " ".join(w + "###" for w in text.split())
        if i % 25 == 1:
            text += "\n" + text
        if i % 40 == 2:
            text = " ".join(w for w in text.split()[:20] for _ in range(6))
        values.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b"])))
    odd = [None, "", " \n\t ", "one", "a\x0bb\x0cc", "x y " * 30, "line\nline\n\nline", "w " * 40, "é" * 9, prose(rng, 30_000)]
    return values + [(1000 + k, t, None, None) for k, t in enumerate(odd)] + [(3, values[3][1], "en", "a")] * 2


def test_quality_rules_equal_sql(spark):
    docs = pd.DataFrame(quality_table(), columns=["doc_id", "text", "lang", "source"])
    frame = spark.createDataFrame(quality_table(), "doc_id long, text string, lang string, source string").selectExpr("*", "1 as kept", "2 as n_words", "3 as _words")
    got = sorted(map(repr, map(tuple, quality.quality_verdicts(frame).collect())))
    con = duckdb.connect()
    con.register("documents", docs)
    want = con.sql(quality.SQL).fetchall()
    assert got == sorted(map(repr, want))
    kept = quality.keep_good(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in want if r[-1])
    assert 0 < len([r for r in want if not r[-1] and not r[-2]]) < 60
    assert not any(r[-1] for r in want if r[0] < 400 and r[0] % 40 == 2)  # each word six times in a row
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # and by shuffling
    try:
        assert got == sorted(map(repr, map(tuple, quality.quality_verdicts(frame).collect())))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert quality.quality_verdicts(frame.limit(0)).count() == 0 == quality.keep_good(frame.limit(0)).count()


def test_repeated_windows_by_brute_force(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    got = {r.doc_id: r.n_repeat_words for r in quality.quality_verdicts(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        n = Counter(windows)
        assert got[i] == len({p for k, x in enumerate(windows) if n[x] > 1 for p in range(k, k + 8)})


def test_fingerprints_by_brute_force(spark):
    rng = random.Random(5)
    values = [(i * 3, prose(rng, rng.randint(0, 90))) for i in range(60)] + [(200, None), (201, ""), (202, "é日" * 30), (203, "ab"), (204, "x" * 20000), (205, prose(rng, 50_000))]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in values], "doc_id long, text string, range string").repartition(3)
    out = {r.doc_id: r for r in fingerprints.compare_with_next(frame).collect()}
    assert len(out) == len(values)
    codes = lambda t: fingerprints.codes_of(t.encode())
    wins = 0
    for k, (i, text) in enumerate(values):
        text, following = text or "", values[(k + 1) % len(values)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fingerprints.encoded(*codes(text)) and r.edited_fingerprint == fingerprints.encoded(*codes(edited))
        assert r.near_edited == fingerprints.likeness(codes(text), codes(edited)) and r.near_next == fingerprints.likeness(codes(text), codes(following))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        wins += r.near_edited > r.near_next
    assert wins >= 50
    assert fingerprints.likeness(codes("some text " * 20), codes("some text " * 20)) == 1
    one = spark.createDataFrame([(1, "alone"), (1, "alone")], "doc_id long, text string")
    assert fingerprints.compare_with_next(one).count() == 2 and fingerprints.compare_with_next(one.limit(0)).count() == 0
    assert fingerprints.fingerprint_texts(frame).count() == len(values)


def test_fingerprints_whatever_is_reused(spark):
    """Ranges are decided once: every document is there once, with its neighbour, also where no shuffle is used again."""
    values = [(i * 7 % 3000, f"text of {i * 7 % 3000} and {i * 7 % 11}") for i in range(3000)]
    frame = spark.createDataFrame(values, "doc_id long, text string").repartition(5)
    in_order = sorted(values)
    want = {i: fingerprints.edited_with_next(t, u) for (i, t), (_, u) in zip(in_order, [*in_order[1:], in_order[0]], strict=True)}
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = fingerprints.compare_with_next(frame).collect()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)
    assert len(got) == 3000 and {r.doc_id: r.edited_sha256 for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


def brute(values, k, percent):
    sets = {}
    for i, t in values:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("words", "percent", "broadcast"), [(3, 85, "10m"), (5, 80, "-1")])
def test_near_duplicates_by_brute_force(spark, words, percent, broadcast, monkeypatch):
    """With large groups of copies, chains in which only neighbours are alike, blocks of a few rows, and either kind of join."""
    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 20_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    rng = random.Random(7)
    values, n = [], 0
    for family in range(12):
        base = prose(rng, rng.randint(30, 120)).split()
        for _ in range(rng.choice((1, 2, 40))):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            values.append((n, " ".join(w)))
            n += 1
    base = prose(rng, 100).split()
    for k in range(30):
        base[3 * k] = base[3 * k + 1] = rng.choice(WORDS)
        values.append((n, " ".join(base)))
        n += 1
    values.append((n, prose(rng, 40_000)))
    n += 1
    values += [(n + k, t) for k, t in enumerate([None, "", " \n", "One", "one", "one two", "ONE  two", "a b c d e f", "é É x y z w"])]
    rng.shuffle(values)
    frame = spark.createDataFrame([(i, t, 1) for i, t in values], "doc_id long, text string, kept int")
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame, words, percent).collect()}
        assert got == brute(values, words, percent)
        kept = neardup.keep_one(frame, words, percent)
        assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in got.items() if i == c}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_near_duplicates_edges(spark):
    frame = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, None)], "doc_id long, text string")
    out = sorted(((r.doc_id or -1, r.component_id, r.kept) for r in neardup.near_duplicates(frame, 3, 85).collect()), key=repr)
    assert out == [(-1, 4, False), (-1, None, True), (4, 4, True), (4, 4, True)]
    assert neardup.near_duplicates(frame.limit(0)).count() == 0 == neardup.keep_one(frame.limit(0)).count()


def test_signatures_meet_in_a_bucket():
    """The pigeonhole guarantee: any pair within the distance shares a slot."""
    rng = random.Random(8)
    for limit in (5, 17, 21):
        ways = neardup.slots(limit)
        for _ in range(300):
            wrong = set(rng.sample(range(neardup.SIZE), limit))
            assert any(not wrong & set(same) for _, _, same in ways)
