"""JSON in the answers of language models: fenced, wrapped in prose, cut off, or streamed."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..shipping import ship

FENCE = re.compile(r"```(?:json|JSON)?\s*\n?(.*?)```", re.S)


def balanced(text: str, opening: str) -> str | None:
    """The first stretch from an opening bracket to its counterpart, quotes and escapes minded."""
    closing = {"{": "}", "[": "]"}[opening]
    start = text.find(opening)
    if start < 0:
        return None
    depth, quoted, at = 0, False, start
    while at < len(text):
        c = text[at]
        if quoted:
            if c == "\\":
                at += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c == opening:
            depth += 1
        elif c == closing:
            depth -= 1
            if not depth:
                return text[start : at + 1]
        at += 1
    return None


def repaired(text: str | None) -> str | None:
    """JSON text (compact) found in an answer; null if there is none."""
    if not text or not text.strip():
        return None
    fenced = FENCE.search(text)
    inner = fenced[1] if fenced else text
    for candidate in (inner.strip(), text.strip(), *(balanced(t, o) for o in "{[" for t in (inner, text))):
        if candidate:
            try:
                return json.dumps(json.loads(candidate), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                continue
    return None


def repair_json(c: Column) -> Column:
    """repaired() as a Column. Brackets need counting, which SQL can't: Arrow batches."""
    ship()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(repaired)

    return run(c)


class AnswerStream:
    """Takes tokens of a streamed JSON object and gives what its "answer" string has gained; escapes are resolved."""

    def __init__(self, field: str = "answer"):
        self.start = re.compile(rf'"{field}"\s*:\s*"')
        self.buffer, self.sent, self.begin, self.done = "", 0, -1, False

    def feed(self, token: str) -> str:
        if self.done:
            return ""
        self.buffer += token
        if self.begin < 0:
            m = self.start.search(self.buffer)
            if not m:
                return ""
            self.begin = m.end()
        at, n = self.begin, len(self.buffer)
        while at < n and self.buffer[at] != '"':
            step = 1
            if self.buffer[at] == "\\":
                step = 6 if self.buffer[at + 1 : at + 2] == "u" else 2
            if at + step > n:
                break
            at += step
        self.done = at < n and self.buffer[at] == '"'
        text = json.loads('"' + self.buffer[self.begin : at].replace("\n", "\\n") + '"', strict=False)
        if text and 0xD800 <= ord(text[-1]) < 0xDC00 and not self.done:  # half of a pair
            text = text[:-1]
        new, self.sent = text[self.sent :], len(text)
        return new


def payload_items(payload: Column) -> Column:
    """JSON array under the first of papers, results, items that a payload has."""
    return F.coalesce(*[F.get_json_object(payload, f"$.{k}") for k in ("papers", "results", "items")])
