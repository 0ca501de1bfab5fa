"""Exact byte-pair encoding by dynamic programming over prefixes.

For every prefix of a piece of text exactly one token can be the last of its encoding. An automaton of the whole
vocabulary (suffix links) yields, for each prefix, the tokens that end there; a token is the last one if and only if
it is compatible with the last token of the prefix that it leaves, that is, if the two of them side by side encode to
themselves. The last tokens are back-pointers: following them from the end gives the ids; adding one per step forward
gives the exact token count of every prefix. The work is linear in the text, also for a "word" of a million letters.
"""

from __future__ import annotations

import json
import math
from functools import lru_cache

import ahocorasick
import regex

#: Bounds of a worker's memory: characters of the longest stretch of text that is kept, entries and characters of a cache of
#: stretches, and entries of the cache of pairs; caches are emptied when full. So a cache holds about 100 MB at its worst,
#: be it many short words or fewer long ones. They never change a result.
KEEP, CACHE_WORDS, CACHE_CHARS, CACHE_PAIRS = 64, 500_000, 6_000_000, 1_000_000


class Kept(dict):
    """What is known of stretches of text."""

    chars = 0

    def keep(self, stretch: str, value) -> None:
        if len(stretch) <= KEEP:
            if len(self) >= CACHE_WORDS or self.chars >= CACHE_CHARS:
                self.clear()
                self.chars = 0
            self.chars += len(stretch)
            self[stretch] = value


class PrefixBpe:
    """tokens: symbols of each mergeable token -> id. rank(a, b): priority of merging two neighbours, None if they don't merge; lower goes first, ties to the left."""

    def __init__(self, tokens: dict[str, int], rank):
        self.tokens, self.rank = tokens, rank
        self._automaton = None
        self.pairs: dict[tuple[str, str], bool] = {}
        self.borders: dict[str, tuple | None] = {}

    @property
    def automaton(self):
        """Built when prefixes are asked for: who only merges never holds it."""
        if self._automaton is None:
            made = ahocorasick.Automaton()
            for token, id_ in self.tokens.items():
                made.add_word(token, (token, id_))
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def merged(self, symbols: list[str]) -> list[str]:
        """Merging as it is defined, for the few symbols of a pair of tokens."""
        parts = list(symbols)
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                r = self.rank(parts[i], parts[i + 1])
                if r is not None and (best is None or r < best[0]):
                    best = (r, i)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def spines(self, token: str):
        """(left, right): what ends at each border of the token while it is merged, from the token down to a symbol, each
        as (part, rank at which it is made, rank at which it is taken up). None if the token's symbols don't merge to it."""
        got = self.borders.get(token, self)
        if got is self:
            parts = [(c, -1, None) for c in token]  # part, rank, the two that it is made of
            while len(parts) > 1:
                best = None
                for i in range(len(parts) - 1):
                    r = self.rank(parts[i][0], parts[i + 1][0])
                    if r is not None and (best is None or r < best[0]):
                        best = (r, i)
                if best is None:
                    break
                r, i = best
                parts[i : i + 2] = [(parts[i][0] + parts[i + 1][0], r, (parts[i], parts[i + 1]))]
            got = None
            if len(parts) == 1:
                got = ([], [])
                for side in (0, 1):
                    node, taken = parts[0], math.inf
                    while node:
                        got[side].append((node[0], node[1], taken))
                        node, taken = node[2] and node[2][side], node[1]
            self.borders[token] = got
        return got

    def tested(self, left: str, right: str) -> bool:
        """compatible() from the spines: false if two parts at the border live at a time and merge before either is taken up.

        Of merges of one rank the left one comes first, hence the unequal comparisons.
        """
        mine = self.spines(right)
        if mine is None or not left:
            return mine is not None
        rank = self.rank
        for a, made_a, taken_a in self.spines(left)[1]:
            for b, made_b, taken_b in mine[0]:
                if made_b < taken_a and made_a <= taken_b:
                    r = rank(a, b)
                    if r is not None and r < taken_a and r <= taken_b:
                        return False
        return True

    def compatible(self, left: str, right: str) -> bool:
        """Whether right can follow left, that is, whether merged() leaves the two as they are; left is "" at the start."""
        got = self.pairs.get((left, right))
        if got is None:
            got = self.tested(left, right)
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = got
        return got

    def last_tokens(self, piece: str) -> list:
        """For every prefix length from 0, (last token, its id). All symbols of the piece must be tokens."""
        last: list = [None] * (len(piece) + 1)
        last[0] = ("", -1)
        pairs, compatible = self.pairs, self.compatible
        for end, found in self.automaton.iter(piece):
            if last[end + 1] is None:
                before = last[end + 1 - len(found[0])]
                if before is not None:
                    ok = pairs.get((before[0], found[0]))
                    if compatible(before[0], found[0]) if ok is None else ok:
                        last[end + 1] = found
        return last

    def ids(self, piece: str) -> list[int]:
        last, at, out = self.last_tokens(piece), len(piece), []
        while at:
            token, id_ = last[at]
            out.append(id_)
            at -= len(token)
        out.reverse()
        return out

    def prefix_counts(self, piece: str) -> list[int]:
        """The token count of every prefix, from the empty one on."""
        counts = [0] * (len(piece) + 1)
        for at, (token, _) in enumerate(self.last_tokens(piece)):
            if at:
                counts[at] = counts[at - len(token)] + 1
        return counts


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


#: Pieces within which merges happen (the usual byte-level pre-tokenisation).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevelBpe:
    """Encodes and decodes whole texts with a byte-level vocabulary file (JSON), special strings included.

    Texts are cut at spaces that are followed by a visible character: there a piece always begins, so such stretches
    encode independently and their ids can be kept for later texts.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        merges = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        letters = byte_letters()
        made = {a + b for a, b in merges} | set(letters)
        self.core = PrefixBpe({t: i for t, i in vocab.items() if t in made}, lambda a, b: merges.get((a, b)))
        back = {c: b for b, c in enumerate(letters)}
        self.bytes = {i: t.encode() if t in self.special else bytes(back[c] for c in t) for t, i in {**vocab, **self.special}.items()}
        self.to_letters = {b: letters[b] for b in range(256)}
        self.pieces = regex.compile(PIECES)
        self.stretches = regex.compile(r" (?=\s|$)")
        self.cut = regex.compile(r"(?= \S)")
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = Kept()  # piece -> ids
        made_in_order = [vocab[a + b] for a, b in merges]
        self.ordered = made_in_order == sorted(made_in_order)
        self._merger = None

    def lettered(self, piece: str) -> str:
        if piece.isascii() and piece.isprintable():
            return piece.replace(" ", self.to_letters[32])
        return piece.encode().decode("latin-1").translate(self.to_letters)

    def merger(self):
        """The same encoding by tiktoken's merging, for operators that need ids but none of the prefixes; None if ids aren't in the order of merging.

        tiktoken merges the neighbours whose joined token has the lowest id, this vocabulary those whose merge comes first. With
        ids in the order of merges these are the same wherever the two are a listed merge. Two neighbours that join to a
        token by an unlisted pair can't come up: the token's own merges, being of lower ids, have then been done before.
        Tests compare both on random strings.
        """
        if self._merger is None:
            import tiktoken

            ranks = {raw: i for i, raw in self.bytes.items() if i not in self.special.values()}
            self._merger = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}) if self.ordered else False
        return self._merger or None

    def merged_ids(self, text: str) -> list[int]:
        """As encode()."""
        merger = self.merger()
        if merger is None:
            return self.encode(text)
        out: list[int] = []
        for part, special in self.sections(text):
            out += [special] if special is not None else merger.encode_ordinary(part)
        return out

    def stretch_ids(self, stretch: str) -> list[int]:
        """Of text without special strings."""
        out: list[int] = []
        for piece in self.pieces.findall(stretch):
            got = self.words.get(piece)
            if got is None:
                got = self.core.ids(self.lettered(piece))
                self.words.keep(piece, got)
            out += got
        return out

    def sections(self, text: str):
        """(stretch, None) and ("", id) for special strings, in order."""
        if self.at_special is None or not any(s in text for s in self.special):
            yield text, None
            return
        at = 0
        for m in self.at_special.finditer(text):
            if m.start() > at:
                yield text[at : m.start()], None
            yield "", self.special[m[0]]
            at = m.end()
        if at < len(text):
            yield text[at:], None

    def stretched(self, text: str) -> list[str]:
        """Text without special strings as stretches that encode independently."""
        if not text:
            return []
        if self.stretches.search(text):
            return [x for x in self.cut.split(text) if x]
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part, special in self.sections(text):
            if special is not None:
                out.append(special)
            else:
                for s in self.stretched(part):
                    out += self.stretch_ids(s)
        return out

    def decode(self, ids) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")


class PieceBpe:
    """Counts, as sentencepiece does with a BPE model with byte fallback, the tokens of every prefix.

    Text gets a leading space mark, spaces become marks; no token has a mark after another character, so stretches that
    begin at a run of marks are independent. A character outside the vocabulary counts one token for each of its bytes.
    """

    MARK = "▁"

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = {model.id_to_piece(i): i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        score = {t: -model.get_score(i) for t, i in plain.items()}
        if any(self.MARK in t.lstrip(self.MARK) for t in plain):
            raise ValueError("a token has a space mark after another character; stretches would not be independent")
        self.core = PrefixBpe(plain, lambda a, b: score.get(a + b))
        self.known = {t for t in plain if len(t) == 1}
        self.split = regex.compile(f"{self.MARK}+[^{self.MARK}]*")
        self.words = Kept()  # stretch -> number of tokens

    def stretched(self, text: str) -> list[str]:
        """The text as independent stretches, marks included."""
        if not text:
            return []
        words = text.split(" ")
        if "" in words or self.MARK in text:
            return self.split.findall(self.MARK + text.replace(" ", self.MARK))
        return [self.MARK + w for w in words]

    def stretch_counts(self, stretch: str) -> list[int]:
        """Token counts of every prefix of a stretch, from the empty one on."""
        out, run = [0], []

        def close() -> None:
            base = out[-1]
            out.extend(base + c for c in self.core.prefix_counts("".join(run))[1:])
            run.clear()

        for c in stretch:
            if c in self.known:
                run.append(c)
            else:
                if run:
                    close()
                out.append(out[-1] + len(c.encode("utf-8", "replace")))
        if run:
            close()
        return out

    def count(self, stretch: str) -> int:
        got = self.words.get(stretch)
        if got is None:
            got = self.stretch_counts(stretch)[-1]
            self.words.keep(stretch, got)
        return got

    def prefix_counts(self, text: str) -> list[int]:
        """Exact token counts of every prefix of the text, from the empty one on."""
        out = [0]
        for stretch in self.stretched(text):
            base = out[-1]
            out.extend(base + c for c in self.stretch_counts(stretch)[1:])
        return [0, *out[2:]] if text else out  # the leading mark is not a character of the text

    def fit(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most budget tokens of which no shorter prefix has more."""
        total, at = 0, 0
        for k, stretch in enumerate(self.stretched(text)):
            n = self.count(stretch)
            if total + n > budget:
                for p, c in enumerate(self.stretch_counts(stretch)):
                    if total + c > budget:
                        return max(0, at + p - 1 - (k == 0))
            total, at = total + n, at + len(stretch) - (k == 0)
        return len(text)


@lru_cache(maxsize=2)
def byte_level(path: str) -> ByteLevelBpe:
    return ByteLevelBpe(path)


@lru_cache(maxsize=2)
def piece_level(path: str) -> PieceBpe:
    return PieceBpe(path)
