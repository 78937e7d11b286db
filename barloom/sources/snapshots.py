"""Published versions of a partitioned table: readers see one whole version, whatever writers do.

A table is a folder with `data/year=Y/month=M/v=ID/` (files are only ever added) and `versions/N.json`, which names the
folder of each month that version N consists of. To publish is one rename of a finished manifest to the next number, which
fails if that number is taken; the writer then merges again with what the other one published. A job that dies before
leaves files that no version names, and the table as it was; `vacuum` removes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Attempts to publish against other writers before giving up.
ATTEMPTS = 20


class LostRace(RuntimeError):
    """Another writer published the version first."""


class Folder:
    """The file operations that a snapshot needs, on any store that Spark reads."""

    def __init__(self, spark: SparkSession, base: str):
        self.jvm, self.base = spark._jvm, base.rstrip("/")
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, name: str) -> object:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def names(self, folder: str) -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self.at(folder))] if self.fs.exists(self.at(folder)) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.at(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, name: str, target: str) -> None:
        """Rename, unless target exists; LostRace then. The store's rename without overwriting decides between writers."""
        java = self.jvm.java.lang
        plainly = java.reflect.Array.newInstance(java.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(self.at(name), self.at(target), plainly)
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                raise LostRace(target) from None
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def _versions(folder: Folder) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in folder.names("versions") if n.endswith(".json") and n[:1].isdigit())


def manifest(spark: SparkSession, base: str, version: int | None = None) -> tuple[int, dict[str, str]]:
    """A version's number, the latest by default, and its folder of each month; 0 and none of a table that doesn't exist."""
    folder = Folder(spark, base)
    known = _versions(folder)
    if not known:
        return 0, {}
    number = known[-1] if version is None else version
    if number not in known:
        raise ValueError(f"there is no version {number}")
    return number, json.loads(folder.text(f"versions/{number:010d}.json"))


def _table(spark: SparkSession, base: str, parts: dict[str, str]) -> DataFrame | None:
    if not parts:
        return None
    root = f"{base.rstrip('/')}/data"
    rows = spark.read.option("basePath", root).option("mergeSchema", True).parquet(*(f"{root}/{p}" for p in sorted(parts.values())))
    text = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    return rows.drop("v").withColumns({"year": text("year", 4), "month": text("month", 2)})


def read(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the latest by default."""
    number, parts = manifest(spark, base, version)
    found = _table(spark, base, parts)
    if found is None:
        raise ValueError(f"{base} has no published rows")
    return found


def upsert(rows: DataFrame, base: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], step: Callable[[str], None] = lambda name: None) -> int:
    """Merge rows (with year and month, as text) into the table and publish; the number of the new version.

    Only months that rows touch are read, merged and written. merge(old, new) gives a month's rows; old is None where the
    table has none. step is told what was done, for tests.
    """
    spark, folder = rows.sparkSession, Folder(rows.sparkSession, base)
    touched = sorted((r.year, r.month) for r in rows.select("year", "month").distinct().collect())  # months of one batch
    for _ in range(ATTEMPTS):
        number, parts = manifest(spark, base)
        step("read")
        old = {k: p for k, p in parts.items() if tuple(k.split("-")) in touched}
        v = uuid.uuid4().hex
        merged = merge(_table(spark, base, old), rows).withColumn("v", F.lit(v))
        merged.repartition("year", "month").sortWithinPartitions("year", "month").write.mode("append").option("compression", "zstd").partitionBy("year", "month", "v").parquet(f"{folder.base}/data")
        step("written")
        fresh = {f"{y}-{m}": f"year={y}/month={m}/v={v}" for y, m in touched}
        draft = f"versions/_draft-{v}"
        folder.write(draft, json.dumps({**parts, **fresh}, sort_keys=True))
        step("drafted")
        try:
            folder.publish(draft, f"versions/{number + 1:010d}.json")
        except LostRace:
            folder.delete(draft)
            for place in fresh.values():
                folder.delete(f"data/{place}")
            continue
        step("published")
        return number + 1
    raise LostRace(f"{base}: other writers were first {ATTEMPTS} times")


def vacuum(spark: SparkSession, base: str, keep: int = 1) -> int:
    """Delete drafts, all but the last `keep` versions, and folders that none of these names; how many folders went.

    Not to be run while others write, whose unpublished folders it would take.
    """
    folder = Folder(spark, base)
    known = _versions(folder)
    for n in folder.names("versions"):
        if n.startswith("_draft-") or n.startswith(".") or (n.endswith(".json") and int(n.removesuffix(".json")) in known[: -max(keep, 1)]):
            folder.delete(f"versions/{n}")
    named = {place for n in known[-max(keep, 1) :] for place in manifest(spark, base, n)[1].values()}
    gone = 0
    for year in folder.names("data"):
        for month in folder.names(f"data/{year}") if year.startswith("year=") else []:
            for v in folder.names(f"data/{year}/{month}"):
                if f"{year}/{month}/{v}" not in named:
                    folder.delete(f"data/{year}/{month}/{v}")
                    gone += 1
    return gone
