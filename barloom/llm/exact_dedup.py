"""Exact duplicates by a 128-bit hash of the normalised text, bytes compared inside groups, in DataFrame functions only.

Texts are equal when they are identical after every run of ASCII white space became one space. Rows are grouped by the
hash and the normalised text itself, so a group whose texts differ by a byte is two classes: that is the comparison, and
copies collapse in the tasks that read them, before anything is shuffled. Each text is shuffled once; the rows of a class
find it by hash alone, and only where a hash has several classes by their bytes too.

A class with more than one in HEAVY_SHARE of all rows is met by its rows through a broadcast (fewer than HEAVY_SHARE rows
of some 100 bytes, whatever the input), all others through a shuffle in which none of them is large.

Edge cases: null text counts as empty and is equal to it; the row that stays has the smallest id, and a null id only stays
where the class has no other; of rows that repeat id and text, one is kept; an empty table gives an empty result; other
columns take no part and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import copies, written

#: A class is heavy with more than one in so many rows.
HEAVY_SHARE = 1000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def md5(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _keyed(docs: DataFrame, id_column: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    bodies = docs.select(F.col(id_column).alias("x_id"), normalised(F.col(text)).alias("x_text"))
    return bodies.withColumn("x_hash", digest(F.col("x_text")))


def classes(keyed: DataFrame) -> DataFrame:
    """x_hash, x_text, keep_id and group_size of every distinct text."""
    return keyed.groupBy("x_hash", "x_text").agg(F.min("x_id").alias("keep_id"), F.count("*").alias("group_size"))


def _met(rows: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """rows with their class: heavy classes through a broadcast, the others through a shuffle. Both are written tables."""
    total = found.agg(F.sum("group_size")).first()[0] or 0
    heavy = F.col("group_size") * HEAVY_SHARE > total
    large = F.broadcast(found.where(heavy))  # fewer than HEAVY_SHARE rows
    return rows.join(large, on).unionByName(rows.join(large, on, "left_anti").join(found.where(~heavy), on))


def judge(docs: DataFrame, id_column: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = md5) -> DataFrame:
    """id, keep_id, group_size, kept and text_sha256 of every row of docs, and its x_hash.

    digest may be any function of the text: a worse one only makes more groups whose bytes tell classes apart.
    """
    keyed, sha = _keyed(docs, id_column, text, digest), F.sha2("x_text", 256).alias("text_sha256")
    found = written(classes(keyed).select("x_hash", "keep_id", "group_size", sha), "exact-classes")
    # rows that repeat id and hash are one row with a count
    rows = written(keyed.groupBy("x_id", "x_hash").agg(F.count("*").alias("x_times")), "exact-rows")
    shared = found.groupBy("x_hash").agg(F.count("*").alias("x_classes")).where("x_classes > 1").select("x_hash")
    if shared.isEmpty():
        out = _met(rows, found, ["x_hash"])
    else:
        several = keyed.join(shared, "x_hash", "left_semi")
        texts = written(classes(several).select("*", sha), "exact-texts")
        apart = written(several.groupBy("x_id", "x_hash", "x_text").agg(F.count("*").alias("x_times")), "exact-apart")
        out = _met(rows.join(shared, "x_hash", "left_anti"), found.join(shared, "x_hash", "left_anti"), ["x_hash"])
        out = out.unionByName(apart.join(texts, ["x_hash", "x_text"]).drop("x_text"))  # whole texts, so none is broadcast
    out = copies(out, "x_times", "x_copy")
    kept = F.col("x_id").eqNullSafe(F.col("keep_id")) & (F.col("x_copy") == 0)
    return out.select(F.col("x_id").alias(id_column), "keep_id", "group_size", kept.alias("kept"), "text_sha256", "x_hash")


def dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = md5) -> DataFrame:
    """One row of docs for each distinct text, all columns as they are; of rows that repeat id and text, any one."""
    key = F.struct(F.col(id_column).alias("i"), F.sha2(normalised(F.col(text)), 256).alias("s"))  # null ids are equal in it
    kept = judge(docs, id_column, text, digest).where("kept")
    kept = written(kept.select(F.struct(F.col(id_column).alias("i"), F.col("text_sha256").alias("s")).alias("x_key")), "exact-kept")
    return docs.withColumn("x_key", key).dropDuplicates(["x_key"]).join(kept, "x_key", "left_semi").drop("x_key")
