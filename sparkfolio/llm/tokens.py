"""BPE encoding and decoding, and token counts, over whole texts."""

from __future__ import annotations

import hashlib
from itertools import accumulate

from pyspark.sql import DataFrame

from .prefix_bpe import Kept, byte_level, piece_level
from .runtime import map_rows, ship, text_of


def encode_texts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string: every text encoded with the byte-level vocabulary at the path tokenizer and decoded again.

    Null text counts as empty: no ids, decoded "". Repeated rows and null ids give a row each, an empty table none. A very long
    text is one row like any other; its work is linear in its length, also without a space in it. Other columns of docs are
    not read, whatever they are called. No shuffle.
    """
    ship(docs.sparkSession)

    def make():
        bpe = byte_level(tokenizer)

        def step(cols):
            ids = [bpe.encode(x or "") for x in cols[1]]
            return [cols[0], ids, [bpe.decode(x) for x in ids]]

        return step

    return map_rows(text_of(docs), make, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode_texts() without keeping the ids.

    ids_sha256 is over the decimal ids joined by commas, decoded_sha256 over the UTF-8 of the decoded text. Rows are as in
    encode_texts(). What is kept of a short stretch of text is its ids in decimal and the bytes they decode to.
    """
    ship(docs.sparkSession)

    def make():
        bpe = byte_level(tokenizer)
        known = Kept()

        def learnt(stretch: str) -> tuple[str, bytes]:
            ids = bpe.stretch_ids(stretch)
            got = ",".join(map(str, ids)), b"".join([bpe.bytes[i] for i in ids])
            known.keep(stretch, got)
            return got

        def one(text: str):
            shown, decoded = [], []
            for part, special in bpe.sections(text):
                if special is not None:
                    shown.append(str(special))
                    decoded.append(bpe.bytes[special])
                    continue
                for s in bpe.stretched(part):
                    got = known.get(s) or learnt(s)
                    shown.append(got[0])
                    decoded.append(got[1])
            ids = ",".join(shown)
            text = b"".join(decoded).decode("utf-8", "replace")
            return ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

        def step(cols):
            return [cols[0], *zip(*[one(x or "") for x in cols[1]], strict=True)]

        return step

    return map_rows(text_of(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def count_tokens(docs: DataFrame, tokenizer: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars: exact token counts with the sentencepiece BPE model at the path tokenizer.

    fit_chars: how many leading characters can be kept so that neither they nor a shorter prefix takes more than limit
    tokens; the whole text if it is within the limit. Counts of all prefixes are what the dynamic programming stores,
    so a budget is answered without encoding again. Null text counts as empty (0 bytes, 0 tokens). Repeated rows and null ids
    give a row each, an empty table none; a very long text is one row, in time linear in its length. Other columns of docs
    are not read, whatever they are called. No shuffle.
    """
    ship(docs.sparkSession)

    def make():
        bpe = piece_level(tokenizer)

        def one(text: str):
            n = sum(map(bpe.count, bpe.stretched(text)))
            return len(text.encode("utf-8", "replace")), n, n > limit, bpe.fit(text, limit) if n > limit else len(text)

        def step(cols):
            return [cols[0], *zip(*[one(x or "") for x in cols[1]], strict=True)]

        return step

    return map_rows(text_of(docs), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, prefix_counts array<int>: the exact token count of every prefix (in characters) of every text, from the empty one on.

    Rows are as in count_tokens(); a null text has one prefix, of 0 tokens.
    """
    ship(docs.sparkSession)

    def make():
        bpe = piece_level(tokenizer)
        return lambda cols: [cols[0], [bpe.prefix_counts(x or "") for x in cols[1]]]

    return map_rows(text_of(docs), make, "doc_id long, prefix_counts array<int>")


def chunk_spans(docs: DataFrame, tokenizer: str, limit: int) -> DataFrame:
    """doc_id, spans array<struct<begin,end>>: texts cut, between stretches, into spans of at most limit tokens where no stretch alone has more.

    Spans follow one another and cover the whole text. A null or empty text has no spans.
    """
    ship(docs.sparkSession)

    def make():
        bpe = piece_level(tokenizer)

        def one(text: str):
            stretches = bpe.stretched(text)
            ends = list(accumulate(map(len, stretches)))
            spans, begin, used = [], 0, 0
            for k, s in enumerate(stretches):
                n = bpe.count(s)
                if used and used + n > limit:
                    spans.append((begin, ends[k - 1] - 1))
                    begin, used = ends[k - 1] - 1, 0
                used += n
            return [*spans, (begin, len(text))] if text else []

        return lambda cols: [cols[0], [[{"begin": a, "end": b} for a, b in one(x or "")] for x in cols[1]]]

    return map_rows(text_of(docs), make, "doc_id long, spans array<struct<begin:long,end:long>>")
