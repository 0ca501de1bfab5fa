"""Providers as a Python data source: spark.read.format("papers").option("provider", ...).load(folder)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..shipping import ship
from .providers import FIELDS, SCHEMA

#: What turns one recorded answer of a provider into rows of SCHEMA (tuples); more may be added before register() is called.
Parser = Callable[[bytes], Iterator[tuple]]


def _names(items) -> list[str]:
    return [n for n in items if n]


def semantic_scholar_rows(raw: bytes) -> Iterator[tuple]:
    import json

    for p in json.loads(raw).get("data") or []:
        ids = p.get("externalIds") or {}
        doi = ids.get("DOI") or ((p.get("url") or "").partition("/doi.org/")[2] or None)
        external = {k: v for k, v in (("semantic_scholar", p.get("paperId")), ("arxiv", ids.get("ArXiv"))) if v is not None}
        yield p.get("title"), p.get("abstract"), _names(a.get("name") for a in p.get("authors") or []), p.get("year"), p.get("venue"), doi, p.get("url"), p.get("citationCount"), external, "semantic_scholar"


def openalex_rows(raw: bytes) -> Iterator[tuple]:
    import json
    import re

    for p in json.loads(raw).get("results") or []:
        place = p.get("primary_location") or {}
        at = {k: w for w, found in (p.get("abstract_inverted_index") or {}).items() for k in found}
        abstract = " ".join(at.get(k, "") for k in range(max(at) + 1)).strip() if at else None
        doi = re.sub(r"^https?://doi\.org/", "", p["doi"]) if p.get("doi") else None
        authors = _names((a.get("author") or {}).get("display_name") for a in p.get("authorships") or [])
        yield p.get("title"), abstract, authors, p.get("publication_year"), (place.get("source") or {}).get("display_name"), doi, place.get("landing_page_url") or p.get("id"), p.get("cited_by_count"), {"openalex": p.get("id")}, "openalex"


def arxiv_rows(raw: bytes) -> Iterator[tuple]:
    import xml.etree.ElementTree as ET

    local = lambda e: e.tag.rpartition("}")[2]
    for entry in (e for e in ET.fromstring(raw) if local(e) == "entry"):
        text = {local(e): " ".join((e.text or "").split()) for e in entry}
        authors = _names((n.text or "").strip() for a in entry if local(a) == "author" for n in a if local(n) == "name")
        year = int(text["published"][:4]) if text.get("published", "")[:4].isdigit() else None
        key = text.get("id", "").partition("/abs/")[2] or None
        yield text.get("title"), text.get("summary"), authors, year, "arXiv", None, text.get("id"), None, {"arxiv": key} if key else {}, "arxiv"


PARSERS: dict[str, Parser] = {"semantic_scholar": semantic_scholar_rows, "openalex": openalex_rows, "arxiv": arxiv_rows}


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Answers:
    """Recorded answers under a folder, of whatever store pyarrow opens; a file, one answer, is a partition that its own reader opens."""

    def __init__(self, options):
        self.folder, self.parse = options["path"], PARSERS[options["provider"]]
        self.with_errors = options.get("errors") == "rows"

    def files(self) -> list[tuple[int, str]]:
        """(time of change in nanoseconds, path), in this order."""
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        return sorted((f.mtime_ns or 0, f.path) for f in found if f.is_file and not f.base_name.startswith((".", "_")))

    def read(self, partition: File) -> Iterator[tuple]:
        from pyarrow import fs

        store = fs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder else fs.LocalFileSystem()
        with store.open_input_stream(partition.path) as f:
            raw = f.read()
        if not self.with_errors:
            yield from self.parse(raw)
            return
        try:
            rows = list(self.parse(raw))
        except Exception as e:  # an answer from outside may be anything
            yield (*[None] * len(FIELDS), partition.path, f"{type(e).__name__}: {e}")
            return
        yield from ((*r, partition.path, None) for r in rows)


class PaperReader(Answers, DataSourceReader):
    def partitions(self) -> list[File]:
        return [File(path) for _, path in sorted(self.files(), key=lambda f: f[1])]


class PaperStreamReader(Answers, DataSourceStreamReader):
    """Answers as they are recorded: an offset is the last file that counts, by time of change, then path. Recorded files don't change; one
    that is moved in with an older time than what was read isn't seen."""

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self.files()
        return {"changed": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[File]:
        at = lambda o: (o["changed"], o["path"])
        return [File(path) for changed, path in self.files() if at(start) < (changed, path) <= at(end)]


class Papers(DataSource):
    """Recorded answers of a provider as rows of papers, read or streamed; option provider: a name in PARSERS. With the option errors set to
    rows, file and error are columns too, and an answer that can't be read is a row that says why."""

    @classmethod
    def name(cls) -> str:
        return "papers"

    def schema(self) -> str:
        return f"{SCHEMA}, file string, error string" if self.options.get("errors") == "rows" else SCHEMA

    def reader(self, schema) -> PaperReader:
        return PaperReader(self.options)

    def streamReader(self, schema) -> PaperStreamReader:
        return PaperStreamReader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(Papers)
