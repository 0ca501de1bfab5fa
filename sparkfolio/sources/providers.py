"""Sources of papers: recorded answers of three services read into one schema, a registry, caching and fan-out; uploads."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import abstract_from_index, doi_from_url, retrieval_key, squeeze
from ..session import checkpoints

SCHEMA = "title string, abstract string, authors array<string>, year int, venue string, doi string, url string, citations int, external_ids map<string,string>, source string"
FIELDS = ["title", "abstract", "authors", "year", "venue", "doi", "url", "citations", "external_ids", "source"]

SEMANTIC_SCHOLAR = "data array<struct<paperId:string,title:string,abstract:string,year:int,venue:string,url:string,citationCount:int,authors:array<struct<name:string>>,externalIds:map<string,string>>>"
OPENALEX = """results array<struct<id:string,title:string,publication_year:int,doi:string,cited_by_count:int,abstract_inverted_index:map<string,array<int>>,
    authorships:array<struct<author:struct<display_name:string>>>,primary_location:struct<landing_page_url:string,source:struct<display_name:string>>>>"""
ARXIV = "entry array<struct<id:string,title:string,summary:string,published:string,author:array<struct<name:string>>>>"


def _names(c: Column, get=lambda x: x["name"]) -> Column:
    return F.filter(F.transform(c, get), lambda n: F.coalesce(n, F.lit("")) != "")


def semantic_scholar(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    """Recorded JSON answers (a document a file), at most limit papers of each (the service's page is 100)."""
    rows = spark.read.schema(SEMANTIC_SCHOLAR).option("multiLine", True).json(path).select(F.explode(F.slice("data", 1, min(limit, 100))).alias("p")).select("p.*")
    doi = F.coalesce(F.col("externalIds")["DOI"], doi_from_url(F.col("url")))
    ids = F.map_filter(F.map_concat(F.create_map(F.lit("semantic_scholar"), F.col("paperId")), F.create_map(F.lit("arxiv"), F.col("externalIds")["ArXiv"])), lambda _, v: v.isNotNull())
    return rows.select("title", "abstract", _names(F.col("authors")).alias("authors"), "year", "venue", doi.alias("doi"), "url", F.col("citationCount").alias("citations"), ids.alias("external_ids"), F.lit("semantic_scholar").alias("source"))


def openalex(spark: SparkSession, path: str, limit: int = 200) -> DataFrame:
    """Recorded JSON answers, at most limit of each; abstracts are put together from inverted indexes, DOIs lose their prefix."""
    rows = spark.read.schema(OPENALEX).option("multiLine", True).json(path).select(F.explode(F.slice("results", 1, min(limit, 200))).alias("p")).select("p.*")
    url = F.coalesce("primary_location.landing_page_url", "id")
    return rows.select(
        "title", F.when(F.col("abstract_inverted_index").isNotNull(), abstract_from_index(F.col("abstract_inverted_index"))).alias("abstract"), _names(F.col("authorships"), lambda a: a["author"]["display_name"]).alias("authors"),
        F.col("publication_year").alias("year"), F.col("primary_location.source.display_name").alias("venue"), F.regexp_replace("doi", r"^https?://doi\.org/", "").alias("doi"), url.alias("url"), F.col("cited_by_count").alias("citations"),
        F.create_map(F.lit("openalex"), F.col("id")).alias("external_ids"), F.lit("openalex").alias("source"),
    )


def arxiv(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    """Recorded Atom feeds: an entry a row, at most limit of each feed, in its order (the service gives 100 at most)."""
    feeds = spark.read.format("xml").option("rowTag", "feed").schema(ARXIV).load(path)
    rows = feeds.select(F.explode(F.slice("entry", 1, min(limit, 100))).alias("e")).select("e.*")
    year = F.year(F.to_timestamp(F.col("published")))
    key = F.get(F.split("id", "/abs/", 2), F.lit(1))
    return rows.select(squeeze(F.col("title")).alias("title"), squeeze(F.col("summary")).alias("abstract"), _names(F.col("author")).alias("authors"), year.cast("int").alias("year"), F.lit("arXiv").alias("venue"), F.lit(None).cast("string").alias("doi"),
        F.col("id").alias("url"), F.lit(None).cast("int").alias("citations"), F.create_map(F.lit("arxiv"), key).alias("external_ids"), F.lit("arxiv").alias("source"))


class Registry:
    """Named providers: functions of (spark, query, limit) that give a DataFrame of FIELDS."""

    def __init__(self) -> None:
        self.providers: dict[str, Callable[[SparkSession, str, int], DataFrame]] = {}

    def register(self, name: str, provider: Callable[[SparkSession, str, int], DataFrame]) -> None:
        self.providers[name] = provider

    def create(self, name: str) -> Callable[[SparkSession, str, int], DataFrame]:
        if name not in self.providers:
            raise KeyError(f"no provider {name!r}; there are {', '.join(sorted(self.providers)) or 'none'}")
        return self.providers[name]

    def search(self, spark: SparkSession, names: list[str], query: str, limit: int) -> tuple[DataFrame, dict[str, str]]:
        """The union of what the providers give, and the errors of those that fail when asked or read: the others still count. All are
        asked at once, and each answer is read once and kept."""
        checkpoints(spark)

        def ask(name: str) -> DataFrame | str:
            try:
                return self.create(name)(spark, query, limit).select(*FIELDS).checkpoint()
            except Exception as e:  # a source outside may fail in any way
                return str(e).splitlines()[0]

        with ThreadPoolExecutor(max(1, len(names))) as pool:
            answers = dict(zip(names, pool.map(inheritable_thread_target(spark)(ask), names), strict=True))
        out = spark.createDataFrame([], SCHEMA)
        for part in answers.values():
            out = out if isinstance(part, str) else out.unionByName(part)
        return out, {name: part for name, part in answers.items() if isinstance(part, str)}


class TableCache:
    """DataFrames kept as Parquet under a folder by key, each until its time is over. Keys are paths without "..".

    An entry is a folder of its own, written as a whole before it counts (_SUCCESS); its age is that of this mark. clock gives
    the seconds since the epoch. Failures of the store never reach the caller of get_or_compute(): the value is computed.
    """

    def __init__(self, spark: SparkSession, folder: str, seconds: float = 3600, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.seconds, self.clock = spark, folder.rstrip("/"), seconds, clock

    def _path(self, key: str):
        if ".." in key.split("/"):
            raise ValueError(f"no key: {key!r}")
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{key}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, key: str, seconds: float | None = None) -> bool:
        fs, p = self._path(f"{key}/_SUCCESS")
        if not fs.exists(p):
            return False
        return self.clock() - fs.getFileStatus(p).getModificationTime() / 1000 < (self.seconds if seconds is None else seconds)

    def get(self, key: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.folder}/{key}") if self.exists(key) else None

    def set(self, key: str, value: DataFrame) -> None:
        value.write.mode("overwrite").parquet(f"{self.folder}/{key}")

    def delete(self, key: str) -> bool:
        fs, p = self._path(key)
        return bool(fs.delete(p, True))

    def delete_pattern(self, pattern: str) -> int:
        """Deletes the entries whose keys a glob matches, whatever their age; how many there were."""
        import fnmatch

        fs, root = self._path("")
        if not fs.exists(root):
            return 0
        found, base, marks = [], fs.makeQualified(root).toUri().getPath().rstrip("/") + "/", fs.listFiles(root, True)
        while marks.hasNext():
            at = marks.next().getPath()
            if at.getName() == "_SUCCESS":
                key = at.getParent().toUri().getPath().removeprefix(base)
                found += [key] if fnmatch.fnmatchcase(key, pattern) else []
        return sum(map(self.delete, found))

    def get_or_compute(self, key: str, compute: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
        """(value, whether it was there)"""
        try:
            if (found := self.get(key)) is not None:
                return found, True
        except Exception:  # a store outside may fail in any way
            return compute(), False
        value = compute()
        try:
            self.set(key, value)
            return self.spark.read.schema(value.schema).parquet(f"{self.folder}/{key}"), False
        except Exception:
            return value, False


class Cached:
    """A provider whose answers are kept by provider, query and limit for so many seconds."""

    def __init__(self, name: str, provider: Callable[[SparkSession, str, int], DataFrame], folder: str, seconds: float = 3600, clock: Callable[[], float] = time.time):
        self.name, self.provider, self.folder, self.seconds, self.clock = name, provider, folder, seconds, clock

    def key(self, query: str, limit: int) -> str:
        import hashlib

        return f"provider={self.name}/query={hashlib.sha256(query.encode()).hexdigest()[:16]}/limit={limit}"

    def __call__(self, spark: SparkSession, query: str, limit: int) -> DataFrame:
        cache = TableCache(spark, self.folder, self.seconds, self.clock)
        return cache.get_or_compute(self.key(query, limit), lambda: self.provider(spark, query, limit).select(*FIELDS))[0]


#: Types that an upload of an extension has; a stated type has to be one of these.
MIME_TYPES = {"pdf": "application/pdf", "txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "json": "application/json", "xml": "application/xml", "html": "text/html", "zip": "application/zip"}


def uploads(spark: SparkSession, path: str, extensions: list[str], max_bytes: int) -> DataFrame:
    """path, length, accepted, reason of files in a folder; contents aren't read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return checked_uploads(files.withColumn("mime_type", F.lit(None).cast("string")), extensions, max_bytes).drop("mime_type")


def checked_uploads(files: DataFrame, extensions: list[str], max_bytes: int) -> DataFrame:
    """files (path, length, mime_type) with reason, why one is not accepted, and accepted. A missing type follows from the
    extension; the type has to be that of an accepted extension; names that begin with a dot are none."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    stated = F.lower(F.trim(F.coalesce("mime_type", F.lit(""))))
    mime = F.when(stated != "", stated).otherwise(F.coalesce(known[ext], F.lit("")))
    allowed = [MIME_TYPES[x] for x in extensions if x in MIME_TYPES]
    reason = (
        F.when(F.col("length") == 0, "empty").when(F.col("length") > max_bytes, "too large").when((name == "") | name.startswith("."), "name")
        .when((ext != "") & ~ext.isin(*extensions), "extension").when(~mime.isin(*allowed), "type")
    )
    return files.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def cache_key(question: Column) -> Column:
    return retrieval_key(question)
