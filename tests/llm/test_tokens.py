"""BPE encoding, token counts and packing against the libraries and brute force."""

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from sparkfolio.llm import packing, tokens  # noqa: E402
from sparkfolio.llm.prefix_bpe import ByteLevelBpe, PieceBpe  # noqa: E402

BYTE, PIECE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
EDGES = ["", " ", "  ", "a  b", "a \n b", " a", "x<|endoftext|>y", " <|endoftext|> ", "don't I'll", "a" * 3000, "ab " * 50, "\r\n\r\n x", "\x00a", "日本語 テキスト", "é x", "!" * 500, "▁ ▁▁x", "\x1c\x85 \xa0z"]


def texts(n=1500):
    rng = random.Random(5)
    letters = " \n\t  aaabbZé日ñ’'s'll!?.,<|>endoftext▁  \x1c\x85123🙂ß"
    return EDGES + ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(n)]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE)


def test_ids_and_decoding_equal_the_library():
    lib, own = library(), ByteLevelBpe(BYTE)
    for t in texts():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids == own.merged_ids(t), repr(t)
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_counts_of_every_prefix_equal_the_library():
    import sentencepiece

    lib, own = sentencepiece.SentencePieceProcessor(model_file=PIECE), PieceBpe(PIECE)
    for t in texts():
        assert sum(map(own.count, own.stretched(t))) == len(lib.encode(t)), repr(t)
    for t in [x for x in texts(200) if len(x) < 100]:
        assert own.prefix_counts(t) == [len(lib.encode(t[:i])) for i in range(len(t) + 1)], repr(t)
        for budget in (0, 1, 3, 7):
            counts = own.prefix_counts(t)
            best = next((i - 1 for i, c in enumerate(counts) if c > budget), len(t))
            assert own.fit(t, budget) == max(0, best), (repr(t), budget)


def test_compatibility_equals_merging():
    rng = random.Random(3)
    for core in (ByteLevelBpe(BYTE).core, PieceBpe(PIECE).core):
        names = list(core.tokens)
        short = [t for t in names if len(t) <= 3 or len(set(t)) <= 2]
        for _ in range(4000):
            a, b = rng.choice(rng.choice((names, short))), rng.choice(rng.choice((names, short)))
            if core.spines(a) is not None:
                assert core.tested(a, b) == (core.merged(list(a + b)) == [a, b]), (a, b)


def table(spark, values):
    return spark.createDataFrame([(i, t, "clash", 1.0) for i, t in values], "doc_id long, text string, decoded string, n_tokens double")


def test_operators_on_null_empty_repeated_and_clashing(spark):
    docs = table(spark, [(1, None), (2, ""), (2, ""), (3, "a b c"), (None, "x")])
    out = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in tokens.encode_digests(docs, BYTE).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert (1, 0, none, none) in out and (2, 0, none, none) in out and len(out) == 4
    assert sorted(len(r.ids) for r in tokens.encode_texts(docs, BYTE).collect()) == [0, 0, 0, 1, 3]
    counted = tokens.count_tokens(docs, PIECE, 2).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.over_limit) for r in counted) == [(0, 1, False), (1, 0, False), (2, 0, False), (2, 0, False), (3, 3, True)]
    for f in (lambda d: tokens.encode_digests(d, BYTE), lambda d: tokens.count_tokens(d, PIECE, 5), lambda d: packing.pack_documents(d, BYTE), lambda d: tokens.chunk_spans(d, PIECE, 5)):
        assert f(docs.limit(0)).count() == 0
    spans = {r.doc_id: [(s.begin, s.end) for s in r.spans] for r in tokens.chunk_spans(table(spark, [(1, "aa bb cc dd"), (2, None)]), PIECE, 2).collect()}
    assert spans[2] == [] and spans[1][0][0] == 0 and spans[1][-1][1] == 11 and all(a[1] == b[0] for a, b in zip(spans[1], spans[1][1:]))


def test_a_megabyte_without_a_space(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefghij漢字かな") for _ in range(400_000))
    docs = table(spark, [(1, long), (2, "x" + long), (3, "short")])
    ids = {i: library().encode(t, add_special_tokens=False).ids for i, t in ((1, long), (2, "x" + long), (3, "short"))}
    out = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in tokens.encode_digests(docs, BYTE).collect()}
    assert out == {i: (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, x in ids.items()}
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, PIECE, 100).collect()} == {1: len(lib.encode(long)), 2: len(lib.encode("x" + long)), 3: len(lib.encode("short"))}
    pieces = packing.pack_documents(docs, BYTE).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in pieces} == {i: len(x) + 1 for i, x in ids.items()}


def test_caches_are_bounded_by_what_they_hold():
    """Long stretches aren't kept, so that 10 000 texts without a space leave nothing behind."""
    rng = random.Random(9)
    byte, piece = ByteLevelBpe(BYTE), PieceBpe(PIECE)
    for _ in range(10_000):
        t = "".join(rng.choices("abcdefgh", k=rng.choice((65, 80))))
        byte.encode(t)
        piece.count("▁" + t)
    assert not byte.words and not piece.words
    assert byte.core._automaton is not None
    other = ByteLevelBpe(BYTE)
    other.merged_ids("only merging")
    assert other.core._automaton is None


def test_prefix_counts_of_texts(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    docs = table(spark, [(1, "some words, é"), (2, None), (3, "")])
    got = {r.doc_id: r.prefix_counts for r in tokens.prefix_token_counts(docs, PIECE).collect()}
    assert got == {1: [len(lib.encode("some words, é"[:i])) for i in range(14)], 2: [0], 3: [0]}


def test_packing_on_null_repeated_and_clashing(spark):
    docs = spark.createDataFrame([(1, None, 9, "x"), (2, "a b", 9, "x"), (2, "a b", 9, "x"), (None, "c", 9, "x")], "doc_id long, text string, start int, sequence_id string")
    got = packing.pack_documents(docs.coalesce(1), BYTE).orderBy("sequence_id", "offset").collect()
    assert [(r.doc_id, r.length) for r in got] == [(1, 1), (2, 3), (2, 3), (None, 2)]


def test_window_cuts_are_optimal():
    rng = random.Random(1)
    for _ in range(300):
        size = rng.choice((8, 16))
        ends = np.cumsum([rng.randint(1, size) for _ in range(rng.randint(1, 9))])
        costs = np.array([rng.choice((0, 2, 5)) for _ in ends], float)
        powers = tuple(1 << k for k in range(size.bit_length() - 1))
        at = [0, *ends.tolist()]

        @lru_cache(None)
        def best(j, at=at, costs=costs, size=size):
            if j == 0:
                return 0
            spans = [(i, at[j] - at[i]) for i in range(j) if at[j] - at[i] <= size]
            return costs[j - 1] + min(best(i) + (0 if n & (n - 1) == 0 else size - n) for i, n in spans)

        cuts = packing.choose_cuts(ends, costs, size, powers)
        cost = {int(e): c for e, c in zip(ends, costs)}
        got = sum(cost[b] + (0 if (b - a) & (b - a - 1) == 0 else size - (b - a)) for a, b in zip([0, *cuts], cuts))
        assert cuts[-1] == ends[-1] and got == best(len(ends))


def test_packing_keeps_every_token_once(spark):
    values = [(i, t) for i, t in enumerate(texts(150))] + [(1000, "word " * 5000), (1001, None)]
    lib = library()
    pieces = packing.pack_documents(spark.createDataFrame(values, "doc_id long, text string").repartition(3), BYTE).toPandas()
    length = pieces.groupby("sequence_id").length.sum()
    assert length.max() <= 1024 and (pieces.offset == pieces.groupby("sequence_id").length.cumsum() - pieces.length).all()
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in length)
    assert padding < 0.02 * length.sum()
    for doc_id, text in values:
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = pieces[pieces.doc_id == doc_id].sort_values("start")
        assert own.start.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own.itertuples())
