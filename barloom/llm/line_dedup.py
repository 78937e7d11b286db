"""Removal of repeated lines by a deletion-neighbourhood join.

Two lines are alike if at most so many words inserted, deleted or replaced make them equal as the bound of both lengths
allows: one in `min_words` words, and one at most, so a line of fewer words has the bound 0 and is alike to equal ones
only. (One word of a line of three is a third of what it says.) A line goes if an equal or alike line stands earlier in
the corpus; places are ordered by document id (nulls last), then the text's hash, then line number.

Every distinct line emits, for each word, the hash of the line without it, and the hash of itself. Lines that lack the
same position and share the rest differ by a replaced word; a line equal to another's shortened form differs by an
inserted one. So the join on equal variants needs no pairs: each variant keeps its earliest line, a partial
aggregation that also tames a variant shared by a third of all lines. The distance to the earliest line is then
verified on the words themselves.

Before that, a lossless filter: lines one edit apart share their first or their second half, so only lines with a half
that another line also has emit variants.

Edge cases: null and empty texts have no lines; lines without a word are never removed and count for nothing; rows
with equal id and text are one document, whose lines are judged once and removed alike from each; ids may be numbers or
strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import written

#: Fixed odd multiplier of the positional hash.
BASE = 0x9E3779B97F4A7C15
#: A line is common if it is more than one in so many.
COMMON = 1000
HALVES = ["half_0", "half_1", "half_2", "half_3"]


def _hash(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def half_keys(words: list[bytes]) -> list[int]:
    """Keys of which lines one edit apart share one: halves as cut for the shorter of two lengths."""
    keys = []
    for n in (len(words), len(words) - 1):
        left = n // 2
        for side, part in ((b"L", words[:left]), (b"R", words[len(words) - (n - left) :])):
            keys.append(_hash([side, b"%d" % n, *part]))
    return keys


def variants(words: list[bytes]) -> np.ndarray:
    """Hashes of the line itself and of the line without its word 0, 1, 2 and so on."""
    n = len(words)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    base = np.full(n, BASE, dtype=np.uint64)
    base[0] = 1
    powers = np.multiply.accumulate(base)[::-1]
    after = h * powers  # weight by the distance from the end
    before = h[:-1] * powers[1:]  # the same, one place nearer to the end
    none = np.zeros(1, dtype=np.uint64)
    head = np.concatenate([none, np.cumsum(before, dtype=np.uint64)])
    tail = np.concatenate([np.cumsum(after[::-1], dtype=np.uint64)[::-1][1:], none])
    return np.concatenate([after.sum(dtype=np.uint64, keepdims=True), head + tail]).view(np.int64)


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one word inserted, deleted or replaced at most makes a and b equal."""
    if abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    same = next((i for i in range(short) if a[i] != b[i]), short)
    return a[same + (len(a) >= len(b)) :] == b[same + (len(b) >= len(a)) :]


def _place(id_column: str, text: str) -> list[Column]:
    return [F.col(id_column).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("text_hash")]


def _occurrences(docs: DataFrame, id_column: str, text: str, min_words: int) -> DataFrame:
    """id, text_hash, line, line_hash and half keys of every line with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows, lines, hashes, keys = [], [], [], []
                for i, t in enumerate(part.column(2).to_pylist()):
                    for k, line in enumerate((t or "").encode().split(b"\n")):
                        if words := line.split():
                            rows.append(i)
                            lines.append(k)
                            hashes.append(_hash(words))
                            keys.append(half_keys(words) if len(words) >= min_words else [None] * 4)
                take = pa.array(rows, pa.int64())
                yield pa.record_batch(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(lines, pa.int32()), pa.array(hashes, pa.int64()), *(pa.array([k[j] for k in keys], pa.int64()) for j in range(4))],
                    names=["id", "text_hash", "line", "line_hash", *HALVES],
                )

    whole = docs.select(*_place(id_column, text), F.col(text).cast("string"))
    kind = docs.schema[id_column].dataType.simpleString()
    return whole.mapInArrow(run, f"id {kind}, text_hash bigint, line int, line_hash bigint, " + ", ".join(f"{h} bigint" for h in HALVES))


def _texts(docs: DataFrame, text: str, min_words: int) -> DataFrame:
    """line_hash and words of every line of min_words words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                found = {}
                for t in batch.column(0).slice(at, 1024).to_pylist():
                    for line in (t or "").encode().split(b"\n"):
                        if len(words := line.split()) >= min_words:
                            found[_hash(words)] = b" ".join(words)
                yield pa.record_batch([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.binary())], names=["line_hash", "words"])

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "line_hash bigint, words binary")


def _variants(lines: DataFrame) -> DataFrame:
    """line_hash, first and every variant of lines (line_hash, first, words); at is -1 for the line itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [variants(w.split(b" ")) for w in part.column("words").to_pylist()]
                sizes = [len(x) for x in found]
                take = pa.array(np.repeat(np.arange(len(found)), sizes))
                where = np.concatenate([np.arange(-1, n - 1, dtype=np.int32) for n in sizes])
                yield pa.record_batch([part.column("line_hash").take(take), part.column("first").take(take), pa.array(np.concatenate(found)), pa.array(where)], names=["line_hash", "first", "variant", "at"])

    return lines.select("line_hash", "first", "words").mapInArrow(run, f"line_hash bigint, first {lines.schema['first'].dataType.simpleString()}, variant bigint, at int")


def _verified(pairs: DataFrame) -> DataFrame:
    """line_hash of the pairs (line_hash, words, other) that are one edit apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("words").to_pylist(), batch.column("other").to_pylist(), strict=True)
            keep = pa.array([within_one(a.split(b" "), b.split(b" ")) for a, b in both], pa.bool_())
            yield pa.record_batch([batch.column("line_hash").filter(keep)], names=["line_hash"])

    return pairs.mapInArrow(run, "line_hash bigint").distinct()


def removed_lines(docs: DataFrame, min_words: int = 8, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, text_hash and the sorted numbers (from 0) of the lines to remove, for documents that have some."""
    lines = written(_occurrences(docs, id_column, text, min_words), "lines")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash", "line")
    firsts = lines.groupBy("line_hash").agg(F.min(place).alias("first"), F.count("*").alias("times"), *(F.max(h).alias(h) for h in HALVES))
    firsts = written(firsts, "first-lines")

    halves = firsts.select("line_hash", F.explode(F.array(*HALVES)).alias("half")).where("half IS NOT NULL")
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    likely = halves.join(shared, "half", "left_semi").select("line_hash").distinct()

    texts = _texts(docs, text, min_words).join(likely, "line_hash", "left_semi").groupBy("line_hash").agg(F.min("words").alias("words"))
    texts = written(texts.join(firsts.select("line_hash", "first"), "line_hash"), "likely-lines")

    every = _variants(texts)
    earliest = every.groupBy("variant", "at").agg(F.min(F.struct("first", "line_hash")).alias("least"), F.count("*").alias("n"))
    among = earliest.groupBy("variant").agg(
        F.sum("n").alias("all_n"),
        F.min("least").alias("all_least"),
        F.min(F.when(F.col("at") == -1, F.col("least"))).alias("self_least"),
    )
    groups = earliest.join(among.where("all_n > 1"), "variant")
    best = F.when(F.col("at") == -1, F.col("all_least")).otherwise(F.least("least", "self_least"))
    groups = groups.select("variant", "at", best.alias("best"))
    near = every.select("line_hash", "variant", "at").join(groups, ["variant", "at"]).groupBy("line_hash").agg(F.min("best").alias("best"))
    near = near.join(texts.select("line_hash", "first"), "line_hash").where("best.first < first").select("line_hash", F.col("best.line_hash").alias("other_hash"))
    words = texts.select("line_hash", "words")
    pairs = near.join(words, "line_hash").join(words.select(F.col("line_hash").alias("other_hash"), F.col("words").alias("other")), "other_hash")
    near = _verified(pairs.select("line_hash", "words", "other"))

    judged = firsts.join(near.withColumn("near", F.lit(True)), "line_hash", "left").where("times > 1 OR near").select("line_hash", "first", "near", "times")
    judged = written(judged, "judged-lines")
    # the commonest lines, fewer than COMMON, are met where they stand; none of the others is a large key
    total = firsts.agg(F.sum("times")).first()[0] or 0
    common, own = F.col("times") * COMMON > total, lines.select("id", "text_hash", "line", "line_hash")
    many = F.broadcast(judged.where(common))
    gone = own.join(many, "line_hash").unionByName(own.join(many, "line_hash", "left_anti").join(judged.where(~common), "line_hash"))
    gone = gone.where(F.coalesce("near", F.lit(False)) | (place != F.col("first")))
    return gone.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def judged(docs: DataFrame, min_words: int = 8, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, text_hash and the sorted numbers of the lines to remove, maybe none, of every row of docs."""
    gone = removed_lines(docs, min_words, id_column, text).select(F.col("id").alias("g_id"), F.col("text_hash").alias("g_hash"), "removed")
    out = docs.select(*_place(id_column, text)).join(gone, F.col("id").eqNullSafe(F.col("g_id")) & (F.col("text_hash") == F.col("g_hash")), "left")
    return out.select("id", "text_hash", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def dedup(docs: DataFrame, min_words: int = 8, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, each text without its removed lines; the columns are those of docs."""
    gone = written(removed_lines(docs, min_words, id_column, text), "removed-lines")
    gone = gone.select(F.col("id").alias("g_id"), F.col("text_hash").alias("g_hash"), F.col("removed").alias("g_removed"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("g_row"), *_place(id_column, text))
    out = rows.join(gone, F.col("id").eqNullSafe(F.col("g_id")) & (F.col("text_hash") == F.col("g_hash")), "left")
    own = F.col(f"g_row.`{text}`")
    kept = F.array_join(F.filter(F.split(own, "\n"), lambda _, i: ~F.array_contains("g_removed", i)), "\n")
    changed = F.when(F.col("g_removed").isNull(), own).otherwise(kept)
    return out.select(*(changed.alias(c) if c == text else F.col(f"g_row.`{c}`").alias(c) for c in docs.columns))
