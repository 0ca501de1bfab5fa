"""Toxicity on held-out rows and the pipeline, stage by stage."""

import random
import zlib

import numpy as np
import pytest

from sparkfolio.llm import toxicity

WORDS = "stone river cloud paper green lamp table window garden silver morning travel".split()
BAD = ["gruntle", "snarfed", "blorpish"]


def labelled(n=700, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = ["the"] + [rng.choice(WORDS) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(5, 60))]
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled()
    odd = [(9000, None), (9001, ""), (9002, "word " * 60_000), (9003, "gruntle " * 3), (None, "the river"), (3, docs[3][1])]
    frame = spark.createDataFrame([(i, t, 0.5) for i, t in docs + odd], "doc_id long, text string, score double")
    out = toxicity.toxicity_scores(frame, spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(docs) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    assert len(held) > 150 and np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95
    assert len({r.score for r in out if r.doc_id in (9000, 9001)}) == 1


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = labelled(300)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    score = lambda rows: sorted((r.doc_id, r.score) for r in toxicity.toxicity_scores(frame, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect())
    assert score(labels) == score(flipped)


def test_one_class_or_no_labels(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.toxicity_scores(frame, none).collect()} == {0}
    assert toxicity.keep_clean(frame, none).count() == 2
    docs, labels = labelled(30)
    assert toxicity.toxicity_scores(frame.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def naive(model, words):
    """Pooled values and logit by the definition of a convolution: every filter at every window of a padded text."""
    vectors = [sum(model.embed[b].astype(float) for b in toxicity.buckets(w)) for w in words]
    vectors += [np.zeros(toxicity.DIM)] * max(max(toxicity.WIDTHS) - 1, max(toxicity.WIDTHS) - len(words))
    n, pooled = max(1, len(words)), []
    for width, filters in zip(toxicity.WIDTHS, model.filters):
        for f in range(toxicity.FILTERS):
            pooled.append(max(sum(float(vectors[i + j] @ filters[j, :, f]) for j in range(width)) for i in range(n)))
    pooled = [max(0.0, x + b) for x, b in zip(pooled, model.bias.tolist())]
    return pooled, sum(x * float(w) for x, w in zip(pooled, model.out)) + model.out_bias


def random_model(seed=5, kind=np.float32):
    rng = np.random.default_rng(seed)
    k = len(toxicity.WIDTHS) * toxicity.FILTERS
    embed = rng.normal(0, 0.5, (toxicity.BUCKETS, toxicity.DIM)).astype(kind)
    embed[0] = 0
    return toxicity.Model(embed, [rng.normal(0, 0.5, (w, toxicity.DIM, toxicity.FILTERS)).astype(kind) for w in toxicity.WIDTHS], rng.normal(0, 0.2, k).astype(kind), rng.normal(0, 0.5, k).astype(kind), 0.3)


def test_scores_equal_a_naive_convolution():
    model, words = random_model(), toxicity.Words(random_model())
    for text in ("", "one", "two words", "a longer text, with some words: twice twice!", "... !!"):
        doc = toxicity.words_of(text)
        words.learn(set(doc))
        rows = words.of(doc)
        pooled, logit = naive(model, doc)
        assert np.allclose(model.pooled(rows), pooled, atol=1e-4) and abs(model.logit(rows) - logit) < 1e-3, text


def test_gradients_equal_numeric_ones():
    model, pad = random_model(6, np.float64), max(toxicity.WIDTHS) - 1
    texts, labels = ["river stone cloud river green", "one", "a b c d e f g"], np.array([1, 0, 1])
    feats = [np.array([toxicity.buckets(w) for w in t.split()] + [(0, 0, 0)] * max(pad, pad + 1 - len(t.split()))) for t in texts]

    def loss():
        p = [1 / (1 + np.exp(-naive(model, t.split())[1])) for t in texts]
        return -np.mean([np.log(x) if y else np.log(1 - x) for x, y in zip(p, labels)])

    grads, keys, rows, out_bias = toxicity.gradients(model, feats, labels)
    params = {"bias": model.bias, "out": model.out, **{f"f{k}": w for k, w in enumerate(model.filters)}}
    rng, eps = np.random.default_rng(1), 1e-6

    def numeric(array, at):
        held = array[at]
        array[at] = held + eps
        up = loss()
        array[at] = held - eps
        down = loss()
        array[at] = held
        return (up - down) / (2 * eps)

    for name, array in params.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in array.shape)
            assert abs(numeric(array, at) - grads[name][at]) < 1e-6, name
    for k, key in list(enumerate(keys))[1:8]:
        assert abs(numeric(model.embed, (key, 3)) - rows[k, 3]) < 1e-6
    held, model.out_bias = model.out_bias, model.out_bias + eps
    up = loss()
    model.out_bias = held - eps
    assert abs((up - loss()) / (2 * eps) - out_bias) < 1e-6


def test_a_document_repeated_many_times_is_one_to_learn_from(spark):
    docs, labels = labelled(60)
    frame = spark.createDataFrame(docs, "doc_id long, text string").unionByName(spark.range(50_000).selectExpr("4L as doc_id", "concat('gruntle ', id % 7) as text"))
    seen = []
    train = toxicity.train
    try:
        toxicity.train = lambda texts, y, weights: seen.append(len(texts)) or train(texts, y, weights)
        toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    finally:
        toxicity.train = train
    assert seen == [sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, _ in docs)]


def test_long_texts_are_learnt_from(spark, monkeypatch):
    """A class that has only long texts is learnt from; short ones come first, and what the driver gets is bounded."""
    monkeypatch.setattr(toxicity, "LONGEST", 300)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = [(i, ("vile gruntle " * 40 if k % 2 else "a fine day ") + f"n{i}") for k, i in enumerate(ids)]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)] + [(999_999, 1)], "doc_id long, toxic int")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    seen = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, y, weights: seen.append([t for t, c in zip(texts, y, strict=True) if c]) or train(texts, y, weights))
    out = {r.doc_id: r.score for r in toxicity.toxicity_scores(frame, labels).collect()}
    assert all((out[i] >= 0.7) == (k % 2 == 1) for k, i in enumerate(ids)) and len(seen[0]) == len(ids) // 2
    toxicity.fit(frame, labels, sample=10)
    assert sum(map(len, seen[1])) <= 10 * 300 and len(seen[1]) >= 1
    toxicity.fit(spark.createDataFrame([*docs, (ids[0] + 10**6, "x"), (ids[1], "vile")], "doc_id long, text string"), labels, sample=1)
    assert len(seen[2]) == 1


def test_thresholds_move_with_the_number_of_labels():
    z, y = np.array([3.0, 2.0, -1.0, -2.0]), np.array([1, 1, 0, 0])
    own = toxicity.best_cut(z, y, (1.0, 1.0))
    assert toxicity.blended(z[:2], y[:2], (1.0, 1.0), 9.0) == 9.0 and abs(toxicity.blended(z, y, (1.0, 1.0), 9.0) - (2 * own + 90) / 12) < 1e-9
    many = toxicity.blended(np.tile(z, 500), np.tile(y, 500), (1.0, 1.0), 9.0)
    assert abs(many - own) < 0.1


def test_best_cut_separates():
    z, y = np.array([3.0, 2.0, -1.0, -2.0]), np.array([1, 1, 0, 0])
    assert toxicity.best_cut(z, y, (90.0, 10.0)) == 0.5


def test_pipeline_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline
    from sparkfolio.llm import neardup, quality

    from .test_documents import brute

    docs, labels = labelled(400, seed=3)
    rng = random.Random(4)
    docs = [(i, t + " " + " ".join(rng.choice(WORDS) for _ in range(30))) for i, t in docs]
    docs += [(1000 + i, docs[i * 4 + 1][1] + " again") for i in range(40)] + [(2000 + i, "### " * 40) for i in range(10)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages, now = dict(corpus_pipeline.STAGES), spark.read.parquet(str(tmp_path / "documents.parquet"))
    good = stages["quality_rules"](spark, now, str(tmp_path))
    want = {r.doc_id for r in quality.quality_verdicts(now).collect() if r.kept}
    assert good.columns == now.columns and {r.doc_id for r in good.collect()} == want and not want & set(range(2000, 2010)) and len(want) > 380
    clean = stages["toxicity"](spark, good, str(tmp_path)).cache()
    kept = {r.doc_id: r.text for r in clean.collect()}
    toxic = {i for i, _, t in labels if t}
    assert clean.columns == now.columns and len(set(kept) & toxic) <= 5 and len(kept) >= 0.95 * len(want - toxic)
    single = stages["near_dedup"](spark, clean, str(tmp_path))
    assert single.columns == now.columns and {r.doc_id for r in single.collect()} == {i for i, (_, c) in brute(kept.items(), 5, 80).items() if i == c}
    packed = stages["packing"](spark, single, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in single.collect()}
    assert neardup.threshold(0.8) > neardup.threshold(0.85)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.select("doc_id", "start", "length").groupBy("doc_id").sum("length").collect())) == sorted(map(tuple, packed.groupBy("doc_id").sum("length").collect()))


def test_stages_on_nulls_empty_tables_and_clashing_columns(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    docs, labels = labelled(120, seed=5)
    rng = random.Random(6)
    rows = [(i, t + " " + " ".join(rng.choice(WORDS) for _ in range(30)), "en", "s") for i, t in docs]
    rows += [(None, None, None, None), (500, None, "en", None), (501, "", None, "s"), (502, " \n", "en", "s"), (503, "the " + " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed"]) for _ in range(60_000)), None, None), (7, rows[7][1], "en", "s"), (None, rows[9][1], "en", "s")]
    clash = ["kept", "toxicity", "_row", "_gone", "n_words", "sig", "key", "label"]
    frame = spark.createDataFrame([(*r, *range(len(clash))) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} int" for c in clash))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for part in (frame, frame.limit(0)):
        now = part
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            got = out.collect()
            if name != "packing":
                assert out.columns == frame.columns and all(tuple(r)[4:] == tuple(range(len(clash))) for r in got)
                now = spark.createDataFrame(got, frame.schema)
        assert bool(got) == (part is frame)
        assert not {r.doc_id for r in got} & {500, 501, 502} and (part is not frame or 503 in {r.doc_id for r in got})


def test_every_labelled_document_is_learnt_from(spark, monkeypatch):
    """More documents of a class than a sample would hold, in shards: all are drawn, counted and used for thresholds, in any order of rows."""
    ids = [i for i in range(9400) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = [(i, "vile gruntle" if i % 40 == 0 else f"fine day {i % 9}") for i in ids]
    labels = spark.createDataFrame([(i, int(i % 40 == 0)) for i in ids], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SHARD", 2500)
    monkeypatch.setattr(toxicity, "STEPS", 20)  # fewer than it takes to draw every document of a shard
    seen, counted, models = [], [], []
    train, count = toxicity.train, toxicity.count_logits
    monkeypatch.setattr(toxicity, "train", lambda texts, y, weights: seen.append((len(texts), len(y))) or train(texts, y, weights))
    monkeypatch.setattr(toxicity, "count_logits", lambda rows, model: counted.append((out := count(rows, model))[4].sum()) or out)
    for parts in (1, 5):
        models.append(toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), labels))
    assert len(ids) > 6000 and seen == [(len(ids), len(ids))] * 2 and counted == [len(ids)] * 2
    assert (models[0].embed == models[1].embed).all() and (models[0].cuts == models[1].cuts).all()
    scores = {t: toxicity.score_texts(spark.createDataFrame([(t,)], "text string"), models[0]).head().toxicity for t in ("vile gruntle", "fine day 3")}
    assert scores["vile gruntle"] >= 0.7 > scores["fine day 3"]


def test_a_shard_draws_all_its_documents(monkeypatch):
    drawn, real = set(), toxicity.gradients
    monkeypatch.setattr(toxicity, "STEPS", 14)
    monkeypatch.setattr(toxicity, "gradients", lambda model, batch, labels: drawn.update(int(d[0, 0]) for d in batch) or real(model, batch, labels))
    docs = [np.array([(k, 0, 0)] * 3, np.uint16) for k in range(1, 1001)]
    labels, alive = (np.arange(1000) % 100 == 0).astype(np.int64), np.arange(toxicity.BUCKETS) > 0
    theta = toxicity.first_theta(alive, 1)
    squares = np.full_like(theta, 1e-3)
    for turn in range(toxicity.ROUNDS):
        toxicity.learn(theta, squares, alive, docs, labels, turn, (1, 2))
    assert drawn == set(range(1, 1001))


def shuffled_rows(df):
    """Rows that the exchanges of df's executed plan wrote."""

    def walk(plan):
        name = plan.getClass().getSimpleName()
        inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else []
        children = plan.children()
        own = plan.metrics().get("shuffleRecordsWritten").get().value() if name == "ShuffleExchangeExec" else 0
        return own + sum(map(walk, [*inner, *(children.apply(i) for i in range(children.size()))]))

    return walk(df._jdf.queryExecution().executedPlan())


def test_texts_without_labels_are_not_shuffled(spark, monkeypatch):
    """Where labels aren't broadcast, too; a filter with too few bits lets more rows through and changes nothing."""
    docs = [(i, f"fine day {i}" if i % 2 else f"vile gruntle {i}") for i in range(-1500, 1500)]
    frame = spark.createDataFrame([*docs, (None, "null id"), (90, "a second text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in [*range(-30, 100), 5000]], "doc_id long, toxic int")
    want = {(i, t, 1 - i % 2) for i, t in docs if i in range(-30, 100) and zlib.crc32(str(i).encode()) % 3 != 1}
    want = {(i, min(t, "a second text") if i == 90 else t, y) for i, t, y in want}
    seen, model = [], random_model()

    def train(texts, y, weights):
        seen.append(({(r.doc_id, r.text, r.toxic) for r in texts.rows.collect()}, shuffled_rows(texts.rows)))
        return model

    monkeypatch.setattr(toxicity, "train", train)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for bits in (toxicity.MOST_BITS, 64):
            monkeypatch.setattr(toxicity, "MOST_BITS", bits)
            toxicity.fit(frame, labels)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert [got for got, _ in seen] == [want, want]
    assert 2 * len(want) <= seen[0][1] <= 5 * len(want) < seen[1][1]


def test_words_have_rows_of_their_own_whatever_they_come_with():
    """A word's row is the same, bit by bit, alone and among others, so equal texts have equal scores wherever they lie."""
    model, words = random_model(), [f"{a}{b}" for a in ("", "é", "¿", "…") for b in WORDS]
    for w, feats in zip(words, map(toxicity.buckets, words)):
        s = w.strip(toxicity._STRIP)
        assert feats == tuple(1 + zlib.crc32(x.encode()) % (toxicity.BUCKETS - 1) for x in (s, "4" + s[:4], "5" + s[:5]))
    together = toxicity.Words(model)
    together.learn(set(words))
    for w in words:
        alone = toxicity.Words(model)
        alone.learn({w})
        assert (alone.of([w]) == together.of([w])).all()
