"""Stored tables with keys: a change rewrites only the buckets that hold changed rows, and is seen whole or not at all.

Rows lie in buckets by a hash of some key columns. A version is a small file that names the folder of each bucket; a change
writes new folders for the buckets that it touches, beside the old ones, and then the next version's file, which no two
writers can both make. Readers keep to the version that they began with.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import dropped, stored


class Outdated(RuntimeError):
    """Another change was committed first; nothing was changed."""


@dataclass(frozen=True)
class Version:
    number: int
    folders: dict[int, str]


class Table:
    """keys: columns that tell rows apart (null equals null). by: the ones among them that a bucket goes by, all unless named.

    buckets: how many, fixed when the table is made; a change costs as much as the buckets that it touches, and a version's file
    has a line a bucket. Columns must be comparable, since a change that changes nothing makes no version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._hadoop = self._jvm.org.apache.hadoop.fs
        self._files = self._at("").getFileSystem(conf)
        about = json.loads(self._text("about.json"))
        self.keys, self.by, self.buckets = about["keys"], about["by"], about["buckets"]
        self.schema = StructType.fromJson(about["schema"])
        self.columns = self.schema.names

    @classmethod
    def made(cls, rows: DataFrame, path: str, keys: list[str], by: list[str] | None = None, buckets: int = 64) -> Table:
        """A new table of rows at an empty path."""
        spark = rows.sparkSession
        of = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/about.json")
        schema = StructType.fromJson(json.loads(rows.schema.json()))
        for field in schema.fields:
            field.nullable = True
        about = {"keys": keys, "by": by or keys, "buckets": buckets, "schema": schema.jsonValue()}
        out = of.getFileSystem(spark._jsc.hadoopConfiguration()).create(of, False)  # an error where there is a table
        out.write(bytearray(json.dumps(about).encode()))
        out.close()
        table = cls(spark, path)
        table._commit(table._written(rows), Version(0, {}), range(buckets))
        return table

    # -- reading ------------------------------------------------------------------------------------------------------------
    def version(self, number: int | None = None) -> Version:
        """The newest version, or the one of a number."""
        if number is None:
            folder = self._at("versions")
            names = [s.getPath().getName() for s in self._files.listStatus(folder)] if self._files.exists(folder) else []
            number = max((int(n[1:-5]) for n in names if n.startswith("v")), default=0)
            if number == 0:
                return Version(0, {})
        return Version(number, {int(b): f for b, f in json.loads(self._text(f"versions/v{number:012d}.json")).items()})

    def rows(self, version: Version | None = None, buckets=None) -> DataFrame:
        """All rows of a version (the newest unless named), or those of some buckets."""
        version = version or self.version()
        paths = [f"{self.path}/{f}" for b, f in sorted(version.folders.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def found(self, wanted: DataFrame, version: Version | None = None) -> DataFrame:
        """Rows whose keys are in wanted (columns named like some keys, those of by among them). Only their buckets are read."""
        rows = self.rows(version, self._buckets(wanted))
        return rows.join(wanted.select(*[F.col(c).alias(f"_w_{c}") for c in wanted.columns]).distinct(), self._same(wanted.columns), "left_semi")

    # -- changes ------------------------------------------------------------------------------------------------------------
    def upsert(self, new: DataFrame, keep: bool = False) -> Version:
        """Puts new's rows in place of those of the same keys; with keep, only adds those whose keys aren't there. new must not
        repeat keys. Rows that are there as they are touch nothing."""
        base = self.version()
        held = stored(new.select(*self.columns))
        try:
            if held.groupBy(*self.keys).count().where("count > 1").limit(1).count():
                raise ValueError(f"keys {self.keys} repeat in the new rows")
            there = self.rows(base, self._buckets(held)).select(*[F.col(c).alias(f"_w_{c}") for c in self.columns])
            alike = self._same(self.keys if keep else self.columns)
            changed = stored(held.join(there, alike, "left_anti"))
            try:
                return self.change(changed.select(*self.keys), changed, base)
            finally:
                dropped(changed)
        finally:
            dropped(held)

    def delete(self, predicate: Column) -> Version:
        """Removes the rows for which the predicate is true. Buckets without such rows stay."""
        base = self.version()
        return self.change(self.rows(base).where(predicate).select(*self.keys), None, base)

    def change(self, remove: DataFrame, add: DataFrame | None = None, base: Version | None = None) -> Version:
        """Removes the rows whose keys are in remove (columns named like some keys, those of by among them) and adds rows; one new
        version, or an error and none. add is read twice and must be the same both times. base: the version that the change was made
        from; if it isn't the newest any more, Outdated."""
        base = base or self.version()
        gone = stored(remove.select(*[F.col(c).alias(f"_w_{c}") for c in remove.columns]).distinct())
        try:
            touched = self._buckets(gone.select(*[F.col(f"_w_{c}").alias(c) for c in remove.columns])) | (self._buckets(add) if add is not None else set())
            if not touched:
                return base
            rest = self.rows(base, touched).join(gone, self._same(remove.columns), "left_anti")
            after = rest if add is None else rest.unionByName(add.select(*self.columns))
            return self._commit(self._written(after), base, touched)
        finally:
            dropped(gone)

    def cleaned(self, keep: int = 1) -> None:
        """Deletes what only versions before the newest so many use. Readers of older ones must have ended."""
        newest = self.version().number
        names = [n for n in range(1, newest + 1) if self._files.exists(self._at(f"versions/v{n:012d}.json"))]
        used = {f for n in names[-keep:] for f in self.version(n).folders.values()}
        for n in names[:-keep]:
            for folder in set(self.version(n).folders.values()) - used:
                self._files.delete(self._at(folder), True)
            self._files.delete(self._at(f"versions/v{n:012d}.json"), False)

    # -- files --------------------------------------------------------------------------------------------------------------
    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _text(self, name: str) -> str:
        stream = self._files.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _same(self, columns: list[str]) -> Column:
        out = F.lit(True)
        for c in columns:
            out = out & F.col(c).eqNullSafe(F.col(f"_w_{c}"))
        return out

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c).cast(self.schema[c].dataType) for c in self.by]), F.lit(self.buckets)).cast("int")

    def _buckets(self, rows: DataFrame) -> set[int]:
        """At most as many as the table has."""
        return {r[0] for r in rows.select(self._bucket()).distinct().collect()}

    def _written(self, rows: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        try:
            rows.select(*self.columns, self._bucket().alias("_bucket")).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        except BaseException:
            self._files.delete(self._at(folder), True)
            raise
        return folder

    def _commit(self, folder: str, base: Version, touched) -> Version:
        names = [s.getPath().getName() for s in self._files.listStatus(self._at(folder))]
        new = {int(n.split("=")[1]): f"{folder}/{n}" for n in names if n.startswith("_bucket=")}
        if not new.keys() <= set(touched):
            self._files.delete(self._at(folder), True)
            raise RuntimeError("rows to add changed between two readings")
        folders = {b: f for b, f in base.folders.items() if b not in set(touched)} | new
        number = base.number + 1
        draft, final = self._at(f"drafts/{uuid.uuid4().hex}"), self._at(f"versions/v{number:012d}.json")
        self._files.mkdirs(self._at("versions"))
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(draft.getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri())
        never = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(draft, final, never)  # fails where that version is
        except Exception as e:
            self._files.delete(self._at(folder), True)
            self._files.delete(draft, False)
            if self._files.exists(final):
                raise Outdated(f"version {number} of {self.path} is another change's") from e
            raise
        return Version(number, folders)
