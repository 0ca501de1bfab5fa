"""Fill-in-the-middle, whitening and repeated passages against brute force."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from sparkfolio.llm import infill, suffixes, whitening


def sha(raw):
    return hashlib.sha256(raw.encode() if isinstance(raw, str) else raw).hexdigest()


TEXTS = ["", None, "a", "Hello world, it's 5 o'clock\nand é is one unit; so is 🙂.", "holds <S> itself", "tail <", "P>x<P", "nul \x00 byte\r\n", "ABC" * 5, "x y " * 40_000, "日本語 text"] + [f"some words of text number {i}, with <{i}> in it" for i in range(300)]


def brute_infill(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if h4 % 100 < 20 else "psm", len(p), len(m), sha(out), sha(text)


def test_fill_in_middle(spark):
    values = [*enumerate(TEXTS), (7, TEXTS[3]), (7, TEXTS[3]), (None, "without an id"), (-4, "negative")]
    docs = spark.createDataFrame([(i, t, "other", 3) for i, t in values], "doc_id long, text string, output string, n int")
    got = [tuple(r) for r in infill.infill_digests(docs).collect()]
    assert sorted(got, key=repr) == sorted((brute_infill(*v) for v in values), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert infill.infill_digests(docs.limit(0)).collect() == []


def test_fill_in_middle_parameters(spark):
    docs = spark.createDataFrame([(i, f"words and more words {i}") for i in range(400)], "doc_id long, text string")
    one, two = (infill.fill_in_middle(docs, seed=k, plain_percent=50, spm_percent=50).collect() for k in (1, 2))
    share = Counter(r.form for r in one)
    assert 150 < share["plain"] < 250 and 60 < share["psm"] < 140 and {r.output for r in one} != {r.output for r in two}
    back = infill.restore_texts(infill.fill_in_middle(docs)).collect()
    assert all(r.restored == f"words and more words {r.doc_id}" for r in back)
    nothing = infill.restore_texts(spark.createDataFrame([(None, "x"), ("psm", None)], "form string, output string")).collect()
    assert nothing[1].restored is None


def test_fill_in_middle_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    values = [v for v in enumerate(TEXTS) if len(v[1] or "") < 1000]
    con.executemany("INSERT INTO documents VALUES (?, ?)", values)
    assert sorted(con.sql(infill.SQL).fetchall(), key=repr) == sorted((brute_infill(*v) for v in values), key=repr)


def brute_whitening(vectors, k):
    x = np.floor(64 * np.array(vectors, float)).astype(int) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    c = (n * x - total) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    deviation = [int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total, strict=True))) for row in x]
    return n, deviation, c @ axes / np.sqrt(values), values / np.trace(c.T @ c / n)


def test_whitening(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40)) * np.linspace(0.1, 2, 40)).astype(np.float32).tolist()
    bad = [(900, None), (901, [None] + [1.0] * 39), (902, [float("nan")] * 40), (903, [float("-inf")] + [0.0] * 39), (904, []), (905, [1.0, 2.0]), (906, [1e30] * 40)]
    rows = [*enumerate(vectors), (None, vectors[0]), (3, vectors[3]), *bad]
    table = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, whitened double")
    used = [*vectors, vectors[0], vectors[3]]
    n, deviation, want, explained = brute_whitening(used, 32)
    got = whitening.whitened_components(table).collect()
    assert len(got) == len(used) * 32 and {r.component for r in got} == set(range(1, 33)) and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-8
    by_id = {(r.vec_id, r.component): r for r in got}
    for k in range(32):
        mine = np.array([by_id[i, k + 1].whitened for i in range(300)])
        sign = np.sign(mine[0] * want[0, k])
        assert np.allclose(mine, sign * want[:300, k], rtol=0, atol=1e-7)
        assert abs(by_id[0, k + 1].explained / explained[k] - 1) < 1e-9
    assert [by_id[i, 1].deviation for i in range(300)] == deviation[:300]


def test_whitening_of_little(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whitened_components(empty).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whitened_components(one).collect() == [] and [r.whitened for r in whitening.whiten(one).collect()] == [[], []]
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.5]) for i in range(10)], "vec_id long, embedding array<double>")
    got = whitening.whiten(flat).collect()  # one direction only
    assert {len(r.whitened) for r in got} == {1} and abs(sum(r.whitened[0] ** 2 for r in got) / 10 - 1) < 1e-9 and abs(got[0].explained[0] - 1) < 1e-9


def test_exact_deviations_of_large_numbers():
    x = np.array([[10**15, 3], [-(10**15), 5]], np.int64)
    total = [int(v) for v in x.sum(axis=0)]
    got = whitening.squared_lengths(whitening.deviations(x, 2, total))
    assert got == [(2 * 10**15) ** 2 + 4, (2 * 10**15) ** 2 + 4]


def brute_removal(values, length):
    raws = [(t or "").encode() for _, t in values]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (doc_id, _), r in zip(values, raws, strict=True):
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((doc_id, len(r), sum(gone), len(re.findall(b"\1+", gone)), sha(bytes(c for c, g in zip(r, gone, strict=True) if not g))))
    return sorted(out, key=repr)


def corpus(rng):
    def prose(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))

    shared = [prose(rng.randint(5, 60)) for _ in range(6)]
    values = [(i, prose(rng.randint(0, 80)) + rng.choice(["", rng.choice(shared)]) + prose(rng.randint(0, 30)) + rng.choice(["", rng.choice(shared)])) for i in range(120)]
    copy = prose(150)
    values += [(1000 + i, copy) for i in range(8)] + [(2000 + i, copy[: rng.randint(50, 700)] + "#" + copy[rng.randint(0, 300) :]) for i in range(30)]
    values += [(3000, None), (3001, ""), (3002, "short"), (None, shared[0] * 2), (None, prose(50)), (3003, "a" * 3000), (3004, "ab" * 700), (3005, "a" * 41), (3006, "é" * 300 + "ü" * 300)]
    return values + [(4000, prose(90))] * 3


@pytest.mark.parametrize("length,kinds", [(40, 2048), (40, 3), (16, 2048), (7, 5)])
def test_repeated_passages(spark, length, kinds, monkeypatch):
    values = corpus(random.Random(length))
    docs = spark.createDataFrame([(i, t, b"x", 1) for i, t in values], "doc_id long, text string, kept binary, run int").repartition(5)
    out = suffixes.remove_repeated(docs, length, kinds)
    got = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), sha(bytes(r.kept))) for r in out.collect()]
    assert sorted(got, key=repr) == brute_removal(values, length)


def test_repeated_passages_of_400_bytes(spark):
    rng = random.Random(4)
    line = "".join(rng.choice("abcdefgh ") for _ in range(900))
    values = [(i, f"{rng.random()} " * 30 + line[rng.randint(0, 200) : rng.randint(500, 900)] + f" {rng.random()}" * 20) for i in range(60)] + [(99, line + "x" + line)]
    docs = spark.createDataFrame(values, "doc_id long, text string")
    assert sorted((tuple(r) for r in suffixes.removal_digests(docs).collect()), key=repr) == brute_removal(values, 400)
    assert suffixes.removal_digests(docs.limit(0)).collect() == []


def test_blocks_change_nothing(monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice("ab ") for _ in range(5000)).encode()
    whole = suffixes.runs_of(text, 40)
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    parts = suffixes.runs_of(text, 40)
    starts = lambda got: sorted((a, s + i, s + h) for a, run in zip(got[0].tolist(), got[2].tolist(), strict=True) for s, n, h in [suffixes.unpacked(run)] for i in range(n))
    assert starts(whole) == starts(parts) and len(starts(whole)) == 5000 - 39


def test_sorted_windows():
    rng = random.Random(7)
    data = np.frombuffer("".join(rng.choice("ab") for _ in range(3000)).encode(), np.uint8)
    for length in (5, 8, 13, 16):
        start = np.arange(len(data) - length + 1)
        group = np.array([rng.randint(0, 1) for _ in start])
        seen = Counter((g, data[s : s + length].tobytes()) for s, g in zip(start, group, strict=True))
        want = [seen[g, data[s : s + length].tobytes()] > 1 for s, g in zip(start, group, strict=True)]
        assert suffixes.sorted_windows(data, start, group, length).tolist() == want
