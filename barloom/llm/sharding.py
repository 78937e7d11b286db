"""Shards by a Feistel permutation with cycle walking over global row numbers, in DataFrame functions only.

Rows get numbers 0..n-1 in an order that their content decides; a keyed Feistel network permutes the numbers, and the
place p of a row gives its shard (p mod shards) and its slot there (p div shards). Counts of shards differ by one at
most, slots have no gaps, and anyone who knows the key, n and a row number can compute its place.

Only (key, size, checksum) rows are shuffled, never texts. Rows alike in these columns are counted before they are
numbered, so a row that repeats millions of times is one row of the shuffle; the numbers are given inside 16,384 hash
ranges, whose running totals are the only thing that meets in one task.

Edge cases: null texts have size 1 (nothing, plus 1) and checksum 0; null ids take part; rows alike in all columns
get neighbouring numbers, in no particular order; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.shared import copies

#: Hash ranges in which rows are numbered.
RANGES = 1 << 14
ROUNDS = 4
#: Steps of cycle walking that one pass can take. The network's domain is below 4 n, so a walk needs more steps than
#: this with a chance below 0.75 ** 192 a row; such a row fails the job instead of taking a wrong place.
WALK = 192


def _feistel(x: Column, half_bits: int, seed: int) -> Column:
    """A permutation of the integers below 2 ** (2 * half_bits)."""
    mask = F.lit((1 << half_bits) - 1).cast("long")
    left, right = F.shiftright(x, half_bits), x.bitwiseAND(mask)
    for k in range(ROUNDS):
        left, right = right, left.bitwiseXOR(F.xxhash64(F.lit(seed), F.lit(k), right).bitwiseAND(mask))
    return F.shiftleft(left, half_bits).bitwiseOR(right)


def place(number: Column, rows: int, seed: int) -> Column:
    """Where the permutation of 0..rows-1 puts a row number."""
    half_bits = max(1, ((max(rows, 2) - 1).bit_length() + 1) // 2)
    walk = number.cast("long")
    # one step as a lambda over the value alone: Spark works it out once per step
    step = lambda x: F.element_at(F.transform(F.array(x), lambda v: _feistel(v, half_bits, seed)), 1)
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        F.struct(step(walk).alias("at")),
        lambda acc, _: F.when(acc["at"] < rows, acc).otherwise(F.struct(step(acc["at"]).alias("at"))),
        lambda acc: acc["at"],
    )
    return F.when(walk < rows, walk).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def numbered(df: DataFrame, order: list[str], number: str = "number") -> tuple[DataFrame, int]:
    """Distinct rows of df's columns in order, each with its number of rows ahead and its copies; and the row count."""
    counted = df.groupBy(*order).agg(F.count("*").alias("copies")).withColumn("r_hash", F.xxhash64(*order))
    counted = counted.withColumn("r_range", F.shiftrightunsigned("r_hash", 64 - (RANGES.bit_length() - 1)).cast("int"))
    totals = counted.groupBy("r_range").agg(F.sum("copies").alias("r_rows"))
    ahead = Window.orderBy("r_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("r_ahead", F.coalesce(F.sum("r_rows").over(ahead), F.lit(0)))
    inside = Window.partitionBy("r_range").orderBy("r_hash", *order).rowsBetween(Window.unboundedPreceding, -1)
    out = counted.withColumn("r_inside", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    # 16,384 rows at most
    out = out.join(F.broadcast(totals.drop("r_rows")), "r_range").withColumn(number, F.col("r_ahead") + F.col("r_inside"))
    return out.drop("r_hash", "r_range", "r_ahead", "r_inside"), df.count()


def shard(docs: DataFrame, shards: int, seed: int = 2026, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, size, text_crc32, shard and slot of every row of docs; law 'rows'."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    sizes = docs.select(F.col(id_column), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).cast("long").alias("text_crc32"))
    rows, n = numbered(sizes, [id_column, "size", "text_crc32"])
    rows = copies(rows, "copies", "copy")
    rows = rows.withColumn("place", place(F.col("number") + F.col("copy"), n, seed))
    return rows.select(
        id_column,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
