"""Which folders a stored catalog consists of.

Every change of a catalog writes into folders of its own,
``<relation>/commit=<id>/<part>=<day>``, and ends by publishing the next
manifest: a small file that lists, for each relation and partition, the
commits that hold its rows.  Readers resolve the latest manifest once, so they
see all of a change or nothing of it, and a change that breaks off leaves
folders that nobody reads (``sweep`` deletes them).  Two changes at a time
cannot both publish: the manifest's number is taken, the later one fails and is
to be repeated.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FOLDER = "_manifest"
#: Spark's name for the partition of a NULL value.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    at, fs = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def write_rows(writer, path: str) -> None:
    """The one way rows reach a catalog's folders."""
    writer.parquet(path)


def no_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A relation without rows, known to be so when the query is planned."""
    nulls = ", ".join(f"cast(null as {f.dataType.simpleString()}) as `{f.name}`" for f in schema.fields)
    return spark.sql(f"select {nulls} where false")


class Manifest:
    """``relations``: name -> {"schema": JSON, "part": partition column or
    None, "folders": {day or "": [commit, ...]}}."""

    def __init__(self, number: int = 0, content: dict | None = None):
        self.number = number
        content = content or {}
        self.relations: dict[str, dict] = content.get("relations", {})
        #: How long the stored balance periods are.
        self.period: str | None = content.get("period")

    @staticmethod
    def latest(spark: SparkSession, root: str) -> "Manifest":
        numbers = [int(n[:-5]) for n in names_in(spark, f"{root}/{FOLDER}") if n.endswith(".json")]
        if not numbers:
            return Manifest()
        return Manifest.numbered(spark, root, max(numbers))

    @staticmethod
    def numbered(spark: SparkSession, root: str, number: int) -> "Manifest":
        at, fs = _path(spark, f"{root}/{FOLDER}/{number:012d}.json")
        stream = fs.open(at)
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(number, json.loads(text))

    def publish(self, spark: SparkSession, root: str) -> None:
        """Makes this the next manifest; an error if that number is taken."""
        new, fs = _path(spark, f"{root}/{FOLDER}/{self.number + 1:012d}.json")
        part, _ = _path(spark, f"{root}/{FOLDER}/.{uuid.uuid4().hex}.part")
        stream = fs.create(part)
        stream.write(bytearray(json.dumps({"relations": self.relations, "period": self.period}).encode()))
        stream.close()
        options = spark.sparkContext._gateway.new_array(
            getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            fs.getUri(), spark._jsc.hadoopConfiguration())
        context.rename(part, new, options)  # without OVERWRITE
        self.number += 1

    def copy(self) -> "Manifest":
        return Manifest(self.number, json.loads(json.dumps({"relations": self.relations, "period": self.period})))

    def days(self, name: str) -> list[str]:
        """The partitions of a relation that have a value, in order."""
        return sorted(d for d in self.relations.get(name, {}).get("folders", {}) if d not in ("", NO_VALUE))

    def read(self, spark: SparkSession, root: str, name: str) -> DataFrame:
        """The rows of a relation, partition column included."""
        entry = self.relations[name]
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        part, base = entry["part"], f"{root}/{name}"
        folders = [f"{base}/commit={c}" + (f"/{part}={d}" if d else "")
                   for d, commits in sorted(entry["folders"].items()) for c in commits]
        if not folders:
            return no_rows(spark, schema)
        return spark.read.schema(schema).option("basePath", base).parquet(*folders).select(*schema.names)


class Change:
    """One change of a catalog: writes first, one ``publish`` last."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.id = spark, root.rstrip("/"), uuid.uuid4().hex
        self.before = Manifest.latest(spark, self.root)
        self.after = self.before.copy()

    def _entry(self, df: DataFrame, name: str, part: str | None) -> dict:
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields]).json()
        entry = self.after.relations.setdefault(name, {"folders": {}})
        return entry | {"schema": schema, "part": part, "folders": dict(entry["folders"])}

    def put_all(self, df: DataFrame, name: str, part: str | None, arrange=lambda df: df, add: bool = False) -> None:
        """The whole relation anew (or, with ``add``, more rows of it)."""
        entry, folder = self._entry(df, name, part), f"{self.root}/{name}/commit={self.id}"
        writer = arrange(df).write
        write_rows(writer.partitionBy(part) if part else writer, folder)
        if part:
            new = [n.split("=", 1)[1] for n in names_in(self.spark, folder) if n.startswith(f"{part}=")]
        else:
            new = [""]
        old = entry["folders"] if add else {}
        entry["folders"] = old | {d: [*old.get(d, []), self.id] for d in new}
        self.after.relations[name] = entry

    def put_day(self, df: DataFrame, name: str, part: str, day, arrange=lambda df: df, add: bool = False) -> None:
        """One partition anew (or, with ``add``, more rows of it)."""
        entry = self._entry(df, name, part)
        write_rows(arrange(df.drop(part)).write, f"{self.root}/{name}/commit={self.id}/{part}={day}")
        entry["folders"][str(day)] = [*(entry["folders"].get(str(day), []) if add else []), self.id]
        self.after.relations[name] = entry

    def put_days(self, df: DataFrame, name: str, part: str, days: list, arrange=lambda df: df) -> None:
        """These partitions anew, by one write; those without rows go."""
        entry, folder = self._entry(df, name, part), f"{self.root}/{name}/commit={self.id}"
        write_rows(arrange(df).write.partitionBy(part), folder)
        new = {n.split("=", 1)[1] for n in names_in(self.spark, folder) if n.startswith(f"{part}=")}
        for day in map(str, days):
            entry["folders"].pop(day, None)
            if day in new:
                entry["folders"][day] = [self.id]
        self.after.relations[name] = entry

    def read(self, name: str) -> DataFrame | None:
        """The relation as it will be; none if it is not in the manifest."""
        return self.after.read(self.spark, self.root, name) if name in self.after.relations else None

    def publish(self) -> None:
        self.after.publish(self.spark, self.root)


def sweep(spark: SparkSession, root: str, keep: int = 2, older_than_hours: float = 24) -> int:
    """Deletes what only manifests before the last ``keep`` list, and folders
    that no manifest lists and no write has touched for so many hours; their
    number."""
    root = root.rstrip("/")
    numbers = sorted(int(n[:-5]) for n in names_in(spark, f"{root}/{FOLDER}") if n.endswith(".json"))
    if not numbers:
        return 0
    live: dict[str, set[str]] = {}
    for number in numbers[-keep:]:
        for name, entry in Manifest.numbered(spark, root, number).relations.items():
            live.setdefault(name, set()).update(
                f"commit={c}" + (f"/{entry['part']}={d}" if d else "") for d, cs in entry["folders"].items() for c in cs)
    last, gone = time.time() - older_than_hours * 3600, 0
    for name, folders in live.items():
        for commit in names_in(spark, f"{root}/{name}"):
            if not commit.startswith("commit=") or commit in folders:
                continue
            at, fs = _path(spark, f"{root}/{name}/{commit}")
            parts = [s for s in fs.listStatus(at) if s.isDirectory()]
            kept = [s for s in parts if f"{commit}/{s.getPath().getName()}" in folders
                    or s.getModificationTime() / 1000 > last]
            if not kept and fs.getFileStatus(at).getModificationTime() / 1000 <= last:
                parts, kept = [fs.getFileStatus(at)], []
            for s in parts:
                if s not in kept:
                    fs.delete(s.getPath(), True)
                    gone += 1
    for number in numbers[:-keep]:
        fs = _path(spark, root)[1]
        fs.delete(_path(spark, f"{root}/{FOLDER}/{number:012d}.json")[0], False)
    return gone
