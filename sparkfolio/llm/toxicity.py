"""Toxicity: a convolutional text classifier in numpy over hashed word embeddings, with a threshold for each language.

It learns from every labelled document that isn't held out. These are dealt into shards; a task learns from a shard by steps of its own,
and after each round what the shards changed is averaged by a Spark aggregation. Which features are alive and the thresholds come from
counts over all of them.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import drop_tables, map_column, map_rows, parts_of, ship, table, text_of, unused

#: Labelled documents and characters of a shard, about: what one task learns from and holds as features.
SHARD, SHARD_CHARS = 16_000, 1 << 26
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 8, 8, (1, 2, 3)
#: A hashed feature that fewer labelled documents have stays without embedding, now and later.
MIN_DOCUMENTS = 3
#: Steps of a shard at least, over all rounds; more if its documents are not all drawn by then.
STEPS, ROUNDS, BATCH, RATE, DECAY = 700, 7, 64, 0.15, 1e-4
#: What an entry is multiplied by before shards' entries are added as whole numbers, in any order; steps of a logit in which thresholds count.
FIXED, LOGIT_STEPS = 1 << 30, 256
#: Score from which a document is predicted toxic, whatever its language.
CUT = 0.7
#: Characters of a text beyond which a sample, if one is asked for, takes others of its class first; times the sample this bounds the
#: characters of a class. Texts are learnt from and scored whole, at any length.
LONGEST = 1 << 16
#: Texts that a threshold's prior counts as: of the texts learnt from before those held back, of everyone before a language.
PRIOR = 10
#: Words kept by a worker, which starts anew when there are more.
CACHE_WORDS = 50_000
#: Bits of the filter by which most texts without a usable label are told before the rest is joined with labels: so many a label, at most MOST_BITS.
LABEL_BITS, MOST_BITS = 16, 1 << 26
#: Frequent words of some languages by which a text's language is guessed from the text alone.
FUNCTION_WORDS = {
    "en": "the of and to is that for with was this are by they have from not",
    "de": "der die und das den von zu mit ist des nicht ein eine auf für auch",
    "es": "el los que y las por con para del una se más como su",
    "fr": "le les et du une est dans pour par sur au ce pas qui vous",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]
_LANGUAGE_OF = {w: k for k, words in enumerate(FUNCTION_WORDS.values()) for w in words.split()}
#: Hashes of what stands before a prefix.
_FOUR, _FIVE = zlib.crc32(b"4"), zlib.crc32(b"5")
_STRIP = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~¡¿«»…“”„‘’"


def buckets(word: str) -> tuple[int, int, int]:
    """A word's features: itself and its first four and five letters, hashed. Without letters and digits there are none (0)."""
    w = word if word.isalnum() else word.strip(_STRIP)
    if not w:
        return 0, 0, 0
    n, whole = BUCKETS - 1, w.encode("utf-8", "replace")
    four, five = (whole[:4], whole[:5]) if len(whole) == len(w) else (w[:4].encode("utf-8", "replace"), w[:5].encode("utf-8", "replace"))
    return 1 + zlib.crc32(whole) % n, 1 + zlib.crc32(four, _FOUR) % n, 1 + zlib.crc32(five, _FIVE) % n


def words_of(text: str) -> list[str]:
    return text.lower().split()


def language(words: list[str]) -> int:
    counts = [0] * len(FUNCTION_WORDS)
    for w in words:
        k = _LANGUAGE_OF.get(w)
        if k is not None:
            counts[k] += 1
    best = max(counts)
    return counts.index(best) if best else len(counts)


@dataclass
class Model:
    """embed: BUCKETS x DIM; filters: for each width (width, DIM, FILTERS); out: weights of the pooled values; cuts: logit threshold by language."""

    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))
    constant: float | None = None

    def projections(self) -> np.ndarray:
        """DIM x (sum of widths * FILTERS): what a word gives to each filter at each place of its window."""
        return np.concatenate([w[j] for w in self.filters for j in range(w.shape[0])], axis=1)

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """Maxima over a document's windows; rows: projections of its words, then of max(WIDTHS) - 1 empty ones."""
        n, at, parts = max(1, len(rows) - max(WIDTHS) + 1), 0, []
        for width in WIDTHS:
            total = rows[:n, at : at + FILTERS]
            for j in range(1, width):
                at += FILTERS
                total = total + rows[j : j + n, at : at + FILTERS]
            at += FILTERS
            parts.append(total.max(axis=0))
        return np.maximum(np.concatenate(parts) + self.bias, 0)

    def logit(self, rows: np.ndarray) -> float:
        return float(self.pooled(rows) @ self.out + self.out_bias)

    def score(self, logit: float, lang: int) -> float:
        """The logit moved so that the language's threshold becomes CUT."""
        return float(1 / (1 + np.exp(-np.clip(logit - self.cuts[lang] + np.log(CUT / (1 - CUT)), -40, 40))))


class Words:
    """Rows of projections for words, computed when first met: sums of those of their features, whatever words they come with. Row 0 is the empty word."""

    def __init__(self, model: Model):
        self.features = model.embed @ model.projections().astype(np.float32)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, self.features.shape[1]), np.float32)

    def learn(self, words: set[str]) -> None:
        new = list(words.difference(self.index))
        if len(self.index) + len(new) > CACHE_WORDS and self.index:
            self.clear()
            new = list(words)
        if new:
            first = len(self.index) + 1
            while first + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            whole, four, five = np.fromiter(chain.from_iterable(map(buckets, new)), np.intp, 3 * len(new)).reshape(-1, 3).T
            self.rows[first : first + len(new)] = self.features[whole] + self.features[four] + self.features[five]
            self.index.update(zip(new, range(first, first + len(new)), strict=True))

    def of(self, words: list[str]) -> np.ndarray:
        n = len(words)
        ids = np.zeros(n + max(max(WIDTHS) - 1, max(WIDTHS) - n), np.intp)
        ids[:n] = np.fromiter(map(self.index.__getitem__, words), np.intp, n)
        return self.rows.take(ids, axis=0)


def gradients(model: Model, batch: list[np.ndarray], labels: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, float]:
    """Of the mean cross entropy of a batch: (of bias, out and each width's filters, touched rows of embed, of these, of out_bias).

    batch: for each document the features of its words, a row of three each, then max(WIDTHS) - 1 rows of zeros. The gradient
    of a maximum goes to the window that has it, the first of equal ones.
    """
    pad = max(WIDTHS) - 1
    grads = {"bias": np.zeros_like(model.bias), "out": np.zeros_like(model.out), **{f"f{k}": np.zeros_like(w) for k, w in enumerate(model.filters)}}
    touched, pulls, grad_b = [], [], 0.0
    for own, label in zip(batch, labels, strict=True):
        vec = model.embed.take(own, axis=0).sum(axis=1)
        n, pooled, where = len(vec) - pad, [], []
        for w, conv in zip(WIDTHS, model.filters, strict=True):
            total = sum(vec[j : j + n] @ conv[j] for j in range(w))
            at = total.argmax(axis=0)
            where.append(at)
            pooled.append(total[at, np.arange(FILTERS)])
        z = np.concatenate(pooled) + model.bias
        h = np.maximum(z, 0)
        err = float(1 / (1 + np.exp(-np.clip(h @ model.out + model.out_bias, -30, 30))) - label)
        grads["out"] += err * h
        grad_b += err
        back = err * model.out * (z > 0)
        grads["bias"] += back
        for k, (w, at) in enumerate(zip(WIDTHS, where, strict=True)):
            g = back[k * FILTERS : (k + 1) * FILTERS]
            for j in range(w):
                grads[f"f{k}"][j] += vec[at + j].T * g
                touched.append(own[at + j])
                pulls.append(g[:, None] * model.filters[k][j].T)
    rows, pull = np.concatenate(touched), np.concatenate(pulls)
    keys, inverse = np.unique(rows, return_inverse=True)
    total = np.zeros((len(keys), model.embed.shape[1]), model.embed.dtype)
    np.add.at(total, inverse.reshape(rows.shape), np.repeat(pull[:, None, :], rows.shape[1], axis=1))
    n = len(batch)
    return {k: g / n for k, g in grads.items()}, keys, total / n, grad_b / n


PAD = max(WIDTHS) - 1
#: Everything that is learnt, one after another in one array, filled up to rows of DIM.
SHAPES = {"embed": (BUCKETS, DIM), "bias": (len(WIDTHS) * FILTERS,), "out": (len(WIDTHS) * FILTERS,), **{f"f{k}": (w, DIM, FILTERS) for k, w in enumerate(WIDTHS)}, "out_bias": (1,)}


def views(theta: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of SHAPES in theta, which they change when they are changed."""
    found, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        found[name] = theta[at : at + n].reshape(shape)
        at += n
    return found


def model_of(theta: np.ndarray) -> Model:
    v = views(theta)
    return Model(v["embed"], [v[f"f{k}"] for k in range(len(WIDTHS))], v["bias"], v["out"], float(v["out_bias"][0]))


def first_theta(alive: np.ndarray, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    theta = np.zeros(-(-sum(int(np.prod(x)) for x in SHAPES.values()) // DIM) * DIM, np.float32)
    for name, v in views(theta).items():
        scale = {"embed": 0.1, "out": 0.3, "bias": 0, "out_bias": 0}.get(name, 0.5)
        v[...] = rng.normal(0, scale, v.shape) if scale else 0
    views(theta)["embed"][~alive] = 0
    return theta


def learn(theta: np.ndarray, squares: np.ndarray, alive: np.ndarray, docs: list[np.ndarray], labels: np.ndarray, turn: int, seed: tuple[int, ...]) -> None:
    """One round of a shard: steps on batches of as many documents of either class, in place. Over all rounds every document is drawn."""
    model, params, sums = model_of(theta), views(theta), views(squares)
    orders = [np.random.default_rng((*seed, c)).permutation(np.flatnonzero(labels == c)) for c in (0, 1)]
    half = BATCH // 2
    steps = -(-max(STEPS, *(-(-len(x) // half) for x in orders)) // ROUNDS)
    for step in range(turn * steps, (turn + 1) * steps):
        batch = np.concatenate([x[np.arange(step * half, (step + 1) * half) % len(x)] for x in orders])
        grads, keys, total, grad_b = gradients(model, [docs[d] for d in batch], labels[batch])
        total = np.where(alive[keys][:, None], total + DECAY * model.embed[keys], 0)
        sums["embed"][keys] += total**2
        model.embed[keys] -= RATE * total / np.sqrt(sums["embed"][keys])
        for k, g in grads.items():
            g = g + DECAY * params[k]
            sums[k] += g**2
            params[k] -= 0.3 * RATE * g / np.sqrt(sums[k])
        sums["out_bias"] += grad_b**2
        params["out_bias"] -= 0.3 * RATE * grad_b / np.sqrt(sums["out_bias"])
        model.out_bias = float(params["out_bias"][0])


class Labelled:
    """A column of labelled texts that lie in Spark: how many there are is known, and values stream to whoever iterates.

    sizes: of each class (documents, characters, least hash of a doc_id).
    """

    def __init__(self, rows: DataFrame, name: str, sizes: dict[int, tuple[int, int, int]]):
        self.rows, self.name, self.sizes = rows, name, sizes

    def __len__(self) -> int:
        return sum(n for n, _, _ in self.sizes.values())

    def __iter__(self):
        return (r[0] for r in self.rows.orderBy("doc_id").select(self.name).toLocalIterator())


def dealt(texts: Labelled, labels: Labelled) -> DataFrame:
    """doc_id, toxic, part (calibrated on, not learnt from), lang, features (three 16-bit numbers a word), copy, shard; a shard in one partition, sorted.

    About a fifth of each class is part; the first by hash never is. A class too rare to fill half a batch in every shard has copies
    of its documents in several shards; copy is 0 for one of them.
    """

    def make():
        known: dict[str, bytes] = {}

        def step(columns):
            ids, toxic, part, values = columns
            langs, features = [], []
            for text in values:
                words = words_of(text)
                if len(known) > CACHE_WORDS:
                    known.clear()
                for w in set(words).difference(known):
                    known[w] = struct.pack("<3H", *buckets(w))
                features.append(b"".join([known[w] for w in words]) + bytes(6 * max(PAD, PAD + 1 - len(words))))
                langs.append(language(words))
            return ids, toxic, part, langs, features

        return step

    sizes = texts.sizes
    shards = max(1, -(-len(texts) // SHARD), -(-sum(c for _, c, _ in sizes.values()) // SHARD_CHARS))
    h, toxic = F.xxhash64("doc_id"), F.col(labels.name)
    first = F.when(toxic == 1, sizes[1][2]).otherwise(sizes[0][2])
    part = (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0) & (h != first)
    rows = map_rows(texts.rows.select("doc_id", toxic.alias("toxic"), part.alias("part"), texts.name), make, "doc_id long, toxic int, part boolean, lang int, features binary")
    copies = [min(shards, max(1, -(-shards * BATCH // (2 * sizes[c][0])))) for c in (0, 1)]
    copy = F.explode(F.sequence(F.lit(0), F.when(F.col("toxic") == 1, copies[1] - 1).otherwise(copies[0] - 1)))
    rows = rows.select("*", copy.alias("copy")).withColumn("shard", F.pmod(h + F.col("copy"), F.lit(shards)).cast("int"))
    return rows.repartition(3 * shards, "shard").sortWithinPartitions("shard", "doc_id")


def features_in(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u2").reshape(-1, 3) for x in column]


def count_features(rows: DataFrame) -> np.ndarray:
    """How many documents of rows have each feature."""
    schema = T._parse_datatype_string("key int, n long")

    def step(batches):
        n = np.zeros(BUCKETS, np.int64)
        for part in parts_of(batches):
            for own in features_in(part.column(0)):
                n[np.unique(own)] += 1
        keys = np.flatnonzero(n)
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(n[keys])], names=["key", "n"])

    got = rows.select("features").mapInArrow(step, schema).groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(BUCKETS, np.int64)
    seen[got["key"].to_numpy()] = got["n"].to_numpy()
    return seen


def one_round(rows: DataFrame, theta: np.ndarray, squares: np.ndarray, alive: np.ndarray, turn: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """theta and squares after a round: each row of DIM entries is the mean over the shards that changed it.

    A shard gives its changed rows as whole numbers, which Spark adds; the driver gets at most the rows that theta has.
    """
    shared = rows.sparkSession.sparkContext.broadcast((theta, squares, alive))
    names = [f"v{k}" for k in range(2 * DIM)]
    schema = T._parse_datatype_string("key int, " + ", ".join(f"{x} long" for x in names))

    def shard_rows(shard, held):
        labels = np.concatenate([x.column(1).to_numpy() for x in held]).astype(np.int64)
        if labels.min() == labels.max():
            return
        before, s, live = shared.value
        t, s = before.copy(), s.copy()
        learn(t, s, live, [own for x in held for own in features_in(x.column(2))], labels, turn, (seed, shard))
        keys = np.flatnonzero((t != before).reshape(-1, DIM).any(axis=1))
        values = np.rint(np.concatenate([t.reshape(-1, DIM)[keys], s.reshape(-1, DIM)[keys]], axis=1).astype(float) * FIXED).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array(np.ascontiguousarray(v)) for v in values.T)], names=["key", *names])

    def step(batches):
        held, now = [], None
        for batch in batches:
            shard = batch.column(0).to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, z in zip(bounds[:-1], bounds[1:], strict=True):
                if z > a:
                    if held and shard[a] != now:
                        yield from shard_rows(now, held)
                        held = []
                    now = int(shard[a])
                    held.append(batch.slice(a, z - a))
        if held:
            yield from shard_rows(now, held)

    got = rows.where(~F.col("part")).select("shard", "toxic", "features").mapInArrow(step, schema).groupBy("key").agg(F.count("*").alias("n"), *(F.sum(x).alias(x) for x in names)).toArrow()
    shared.destroy()
    keys, n = got["key"].to_numpy(), got["n"].to_numpy()
    out = []
    for before, own in ((theta, names[:DIM]), (squares, names[DIM:])):
        after = before.copy()
        after.reshape(-1, DIM)[keys] = np.stack([got[x].to_numpy() / n / FIXED for x in own], axis=1)
        out.append(after)
    return out[0], out[1]


def count_logits(rows: DataFrame, model: Model) -> tuple[np.ndarray, ...]:
    """lang, part, toxic, logit (to a LOGIT_STEPS-th, within 128 of zero) and how many documents of rows have these."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = T._parse_datatype_string("lang int, part boolean, toxic int, bin int")

    def step(batches):
        own: Model = shared.value
        projections = own.projections()
        for part in parts_of(batches):
            logits = [own.logit(own.embed.take(x, axis=0).sum(axis=1) @ projections) for x in features_in(part.column(3))]
            bins = np.rint(np.clip(logits, -128, 128) * LOGIT_STEPS)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(bins.astype(np.int32))], names=["lang", "part", "toxic", "bin"])

    names = ["lang", "part", "toxic", "bin"]
    got = rows.select("lang", "part", "toxic", "features").mapInArrow(step, schema).groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).toArrow()
    lang, part, toxic, bins, n = (got[x].to_numpy() for x in (*names, "n"))
    return lang, part.astype(bool), toxic, bins / LOGIT_STEPS, n


def train(texts: Labelled, labels: Labelled, weights: tuple[float, float], seed: int = 7) -> Model:
    """Learns from all texts with labels 0 and 1 (both must occur); weights: of each class in the population, for the thresholds.

    Thresholds are calibrated on a fifth of each class, which nothing else is learnt from, and averaged with those of the texts
    learnt from, which count as PRIOR texts: with few labels these lead, with many they hardly matter, and no number of
    labels switches. A language's threshold is averaged with everyone's in the same way, by the texts of its rarer class.

    The features of the texts are on the executors' disks meanwhile. The order of rows and the number of partitions don't matter.
    """
    rows = dealt(texts, labels).persist(StorageLevel.DISK_ONLY)
    once = rows.where("copy = 0")
    alive = count_features(once) >= MIN_DOCUMENTS
    alive[0] = False
    theta = first_theta(alive, seed)
    squares = np.full_like(theta, 1e-3)
    for turn in range(ROUNDS):
        theta, squares = one_round(rows, theta, squares, alive, turn, seed)
    model = model_of(theta)
    langs, part, y, logits, times = count_logits(once, model)
    rows.unpersist()
    of = lambda some: (logits[some], y[some], weights)
    everyone = blended(*of(part), best_cut(*of(~part), times[~part]), times[part])
    model.cuts[:] = [blended(*of(part & (langs == k)), everyone, times[part & (langs == k)]) for k in range(len(LANGUAGES))]
    return model


def blended(logits: np.ndarray, labels: np.ndarray, weights: tuple[float, float], prior: float, times: np.ndarray | None = None) -> float:
    """best_cut() averaged with a prior that counts as PRIOR texts; the prior alone if a class is missing."""
    times = np.ones(len(labels), np.int64) if times is None else times
    n = min(times[labels == c].sum() for c in (0, 1))
    return float((n * best_cut(logits, labels, weights, times) + PRIOR * prior) / (n + PRIOR)) if n else prior


def best_cut(logits: np.ndarray, labels: np.ndarray, weights: tuple[float, float], times: np.ndarray | None = None) -> float:
    """The logit, half way between neighbours, of the best F1 where classes have their weights in the population; of equals the middle one.

    times: how many texts have a logit and a label, one each if not given. Equal logits fall on the same side.
    """
    times = np.ones(len(labels), np.int64) if times is None else times
    order = np.argsort(-logits, kind="stable")
    z = logits[order]
    hits = np.cumsum((labels * times)[order]) * weights[1] / max(1, times[labels == 1].sum())
    false = np.cumsum(((1 - labels) * times)[order]) * weights[0] / max(1, times[labels == 0].sum())
    f1 = 2 * hits / (hits + false + weights[1])
    f1[:-1][z[1:] == z[:-1]] = -1
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    k = int(best[len(best) // 2])
    return float((z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 1)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def maybe_labelled(usable: DataFrame, n: int) -> Column:
    """True for every doc_id (a long) among usable's n and for few others, so that the exact join that must follow doesn't shuffle their texts.

    A bit for each hash of a labelled doc_id, MOST_BITS at most whatever the labels: with more labels than that has bits for,
    more others pass, all of them in the end.
    """
    bits = 1 << max(6, min(MOST_BITS, LABEL_BITS * max(1, n)).bit_length() - 1)
    place = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(bits))
    held = usable.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("word"))
    got = held.toArrow()
    words = np.zeros(bits >> 6, np.int64)
    words[got["at"].to_numpy()] = got["word"].to_numpy()
    shared = usable.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def there(p: pd.Series) -> pd.Series:
        at = p.to_numpy()
        return pd.Series((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    return there(place)


def fit(docs: DataFrame, labels: DataFrame, sample: int | None = None) -> Model:
    """Learns toxic from every row of labels, none held out, whose document is in docs.

    Labels other than 0 and 1, null ids and labels without a document are passed over; of several labels of a document the
    largest counts, of several texts the smallest. With one class only, every score is constant: half of CUT, or
    (1 + CUT) / 2 with toxic rows only.

    sample, for trials: at most so many documents of each class instead, in the order of a hash of doc_id, those with texts up to
    LONGEST first; longer ones, whole, as far as the class stays within sample times LONGEST characters, the first in any case.

    Labels are a table while this runs, whose size tells the planner whether to join by broadcast; many are joined by shuffling
    texts that may have a label, which a filter of bounded size tells (maybe_labelled()).
    """
    spark = docs.sparkSession
    ship(spark)
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    usable = table(clean.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    texts = text_of(docs).where("text is not null").where(~held_out(F.col("doc_id")))
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    may = maybe_labelled(usable, sum(counts.values()))

    def sized(some):
        return texts.select("doc_id", F.length("text").alias("n")).where(may).join(some, "doc_id").groupBy("doc_id", "toxic").agg(F.max("n").alias("n"))

    chosen = usable if sample is None else spark.createDataFrame(sampled(sized(usable), sample), "doc_id long, toxic int")
    found = sized(chosen).groupBy("toxic").agg(F.count("*").alias("n"), F.sum("n").alias("chars"), F.min(F.xxhash64("doc_id")).alias("first")).collect()
    sizes = {r["toxic"]: (r["n"], r["chars"], r["first"]) for r in found}
    if len(sizes) < 2:
        model = Model(np.zeros((1, 1)), [], np.zeros(0), np.zeros(0), 0.0, constant=(1 + CUT) / 2 if 1 in sizes else CUT / 2)
    else:
        rows = texts.where(may).join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
        model = train(Labelled(rows, "text", sizes), Labelled(rows, "toxic", sizes), (float(counts[0]), float(counts[1])))
    drop_tables(usable)
    return model


def sampled(sized: DataFrame, sample: int) -> list[tuple[int, int]]:
    """doc_id and toxic of the rows (doc_id, toxic, n) that fit()'s sample takes."""
    chosen = []
    for c in (0, 1):
        left = sample * LONGEST
        order = [F.col("n") > LONGEST, F.xxhash64("doc_id"), F.col("doc_id")]
        for k, r in enumerate(sized.where(F.col("toxic") == c).orderBy(*order).limit(sample).collect()):
            left -= r["n"]
            if k and left < 0:
                break
            chosen.append((r["doc_id"], c))
    return chosen


def score_texts(docs: DataFrame, model: Model, out: str = "toxicity") -> DataFrame:
    """docs's rows (which need a text; all columns stay, but one called as out) with a score from 0 to 1 as the last column. No shuffle.

    Texts are scored whole; a null or empty one is a document without words. The model, of a fixed size of about a megabyte, is broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def make():
        own: Model = shared.value
        words = None if own.constant is not None else Words(own)

        def step(texts):
            if words is None:
                return [own.constant] * len(texts)
            scores = []
            for text in texts:
                doc = words_of(text or "")
                words.learn(set(doc))
                scores.append(own.score(own.logit(words.of(doc)), language(doc)))
            return scores

        return step

    return map_column(docs.drop(out), "text", make, out, T.DoubleType())


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; held_out tells that the row's label can't have been learnt from.

    A null or empty text has the score of a document without words; repeated rows have a row and the same score each; a
    row without doc_id is scored and not held out. An empty table gives an empty one. Other columns are not read.
    """
    scored = score_texts(text_of(docs), fit(docs, labels))
    predicted = (F.col("toxicity") >= CUT).cast("int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), predicted.alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns (whatever these are called), that score below CUT; rows as in toxicity_scores()."""
    score = unused(docs, "toxicity")
    return score_texts(docs, fit(docs, labels), score).where(F.col(score) < CUT).select(*[F.col(f"`{c}`") for c in docs.columns])
