"""Tables whose months differ in columns and types, read as one, with pruning before anything is opened.

The folders of a range are named by listing directories, so months and factors outside it are never opened. Folders whose
footers Spark can merge are one group with one schema; where it can't (a long here, a double there), the folders are halved
until it can, each step one distributed job over footers. Groups are read by their own schemas, widened to common types, and
put together by column names.

A catalogue keeps groups and the codes' spellings of a table in a file beside it, so that later reads open no footers and
push the wanted codes, as they are spelt in the files, into the scan. It is made anew when the table's folders changed.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.scalar import code
from barloom.sources.snapshots import Folder

_WHOLE = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]


def folders(spark: SparkSession, base: str, start: date | None = None, end: date | None = None, below: Sequence[str] = ("",)) -> list[str]:
    """Paths of the existing year=/month= folders of the months of [start, end), or of all, below base or base/below."""
    root, out = Folder(spark, base), []
    for prefix in below:
        for year in root.names(prefix):
            y = re.fullmatch(r"year=(\d+)", year)
            for month in root.names(f"{prefix}/{year}".strip("/")) if y else []:
                m = re.fullmatch(r"month=(\d+)", month)
                at = m and int(y[1]) * 100 + int(m[1])
                if at and (start is None or at >= start.year * 100 + start.month) and (end is None or at <= end.year * 100 + end.month):
                    out.append("/".join(x for x in (root.base, prefix, year, month) if x))
    return sorted(out)


@dataclass(frozen=True)
class Group:
    """Folders that one schema reads."""

    paths: list[str]
    schema: T.StructType


def groups(spark: SparkSession, base: str, paths: Sequence[str]) -> list[Group]:
    """paths in order, split into runs whose footers merge."""
    if not paths:
        return []
    try:
        # the merged schema has the partition columns too
        return [Group(list(paths), spark.read.option("basePath", base).option("mergeSchema", True).parquet(*paths).schema)]
    except Exception as error:  # Spark raises this one as it comes from the JVM
        if len(paths) == 1 or "MERGE" not in str(error).upper():
            raise
        half = len(paths) // 2
        first, second = groups(spark, base, paths[:half]), groups(spark, base, paths[half:])
        if first[-1].schema == second[0].schema:  # neighbours of a cut through equal folders
            first[-1:], second[:1] = [Group(first[-1].paths + second[0].paths, second[0].schema)], []
        return first + second


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both: the larger whole number, double, timestamp, or else string."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if a in _WHOLE and b in _WHOLE:
        return _WHOLE[max(_WHOLE.index(a), _WHOLE.index(b))]
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    if all(isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) for t in (a, b)):
        return T.TimestampType()
    return T.StringType()


def common(schemas: Sequence[T.StructType]) -> T.StructType:
    """Columns of all schemas in order of appearance, each of a type that holds all of its own."""
    types: dict[str, T.DataType] = {}
    for schema in schemas:
        for f in schema.fields:
            types[f.name] = wider(types[f.name], f.dataType) if f.name in types else f.dataType
    return T.StructType([T.StructField(n, t) for n, t in types.items()])


def read(spark: SparkSession, base: str, found: Sequence[Group]) -> DataFrame:
    """The groups' rows with the columns of all, null where a group has none, and `file`, the name of a row's file."""
    wanted, out = common([g.schema for g in found]), None
    for g in found:
        rows = spark.read.schema(g.schema).option("basePath", base).parquet(*g.paths)
        have = set(rows.columns)
        rows = rows.select(*((F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.fields), F.col("_metadata.file_name").alias("file"))
        out = rows if out is None else out.unionByName(rows)
    return out


@dataclass(frozen=True)
class Catalog:
    """Groups and spellings of a table: stored, and valid for its folders as they were."""

    base: str
    found: list[Group]
    spellings: dict[str, list[str]]

    def within(self, start: date, end: date) -> list[Group]:
        """The groups' folders of the months of [start, end)."""
        def inside(path: str) -> bool:
            m = re.search(r"year=(\d+)/month=(\d+)$", path)
            return start.year * 100 + start.month <= int(m[1]) * 100 + int(m[2]) <= end.year * 100 + end.month

        kept = [Group([p for p in g.paths if inside(p)], g.schema) for g in self.found]
        return [g for g in kept if g.paths]

    def spelt(self, codes: Sequence[str]) -> list[str]:
        """The codes as the files spell them."""
        return sorted(s for c in codes for s in self.spellings.get(c, []))


def _mark(spark: SparkSession, paths: Sequence[str]) -> str:
    """Changes with the folders' files, their sizes and times."""
    seen = []
    for p in paths:
        root = Folder(spark, p)
        seen += [(p, f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in root.fs.listStatus(root.at(""))]
    return hashlib.sha256(json.dumps(sorted(seen)).encode()).hexdigest()


def catalog(spark: SparkSession, base: str, at: str, column: str = "htsc_code") -> Catalog:
    """The catalogue of the table at base, kept in folder `at`; made if there is none for the folders as they are now.

    Spellings are one row per code and its variants, so they are bounded by the securities.
    """
    base = base.rstrip("/")
    paths, store = folders(spark, base), Folder(spark, at)
    name = f"catalog-{_mark(spark, paths)}.json"
    if name in store.names(""):
        told = json.loads(store.text(name))
        return Catalog(base, [Group(g["paths"], T.StructType.fromJson(g["schema"])) for g in told["groups"]], told["spellings"])
    found, spellings = groups(spark, base, paths), {}
    if found:
        raw = read(spark, base, found).select(F.col(column).alias("raw"), code(F.col(column)).alias("code")).distinct()
        for r in raw.where("code IS NOT NULL").collect():
            spellings.setdefault(r.code, []).append(r.raw)
    for old in store.names(""):
        if old.startswith("catalog-"):
            store.delete(old)
    store.write(name, json.dumps({"groups": [{"paths": g.paths, "schema": json.loads(g.schema.json())} for g in found], "spellings": spellings}))
    return Catalog(base, found, spellings)
