"""How sources differ in their words: chi-square-like distances between the term shares of groups, in whole numbers.

A part (a language, say) holds groups (sources). A part keeps the terms found in enough of its documents; with V of them, a
group that uses a term `count` times among N has the share p = 1 + floor(scale * (count + 1) / (N + V)), and the distance of
a share p from a share q is floor((p - q)^2 / q). `pairs` sums it over all kept terms for each two groups of a part, `terms`
lists a group's terms whose share exceeds that of the part.

Pairs are row accumulation over a term-major index. The index is cut into blocks of whole postings by hash of the term; in
a block, each group walks its own terms, and each term's postings are scattered into one dense accumulator over the part's
groups. So a posting meets another only inside the accumulator, and no pair of postings is ever a row: a block hands on one
array per group. What a group and a peer share by neither using a term has a closed form: the accumulators start from the
baselines (count 0) of both, corrected for the terms that one of them uses (by how often each share occurs) and then for
those that both use.

Memory: counting keeps FLUSH entries in a task; a block holds about BLOCK postings and one accumulator of a number per
group of the part. The result has a row for each two groups of a part, by definition.

Edge cases: null text, part or group count as ''; groups without terms take part with their baseline; a part without kept
terms has pairs of value 0 and no terms; long texts are counted in slices; an empty table gives an empty result; other
columns take no part and may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.shared import written

#: Terms are runs of ASCII letters and characters beyond ASCII; only A-Z have another case. (As bytes of UTF-8.)
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SLICE, FLUSH, BLOCK = 1 << 20, 1 << 19, 1 << 18
#: Groups' facts are dealt to so many places, so that a group with many terms isn't one key of a join.
DEALT = 16
COUNTS = "part string, name string, term string, n bigint, docs bigint"


def slices(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The terms of a text, a slice of it at a time; slices end between terms."""
    text, at = text.translate(TERMS), 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part, group and term: occurrences and documents, summed over what one task holds at a time."""
    found: dict[tuple, tuple[Counter, Counter]] = {}
    held = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (part, name), (times, docs) in found.items():
            terms = list(times)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part] * len(terms), pa.string()), "name": pa.array([name] * len(terms), pa.string()), "term": pa.array([t.decode("utf-8", "replace") for t in terms], pa.string()),
                "n": pa.array([times[t] for t in terms], pa.int64()), "docs": pa.array([docs[t] for t in terms], pa.int64()),
            })
        found.clear()

    for batch in batches:
        for part, name, text in zip(batch.column("part").to_pylist(), batch.column("name").to_pylist(), batch.column("text")):
            times, docs = found.setdefault((part, name), (Counter(), Counter()))
            before, own = len(times), set()
            for terms in slices(text.as_py()):
                times.update(terms)
                own.update(terms)
            docs.update(own)
            held += len(times) - before
            if held > FLUSH:
                yield from rows()
                held = 0
    yield from rows()


def term_counts(docs: DataFrame, part: str, name: str, text: str) -> DataFrame:
    """part, name, term, n (occurrences) and docs (documents with it), for every group and term."""
    body = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(body(part).alias("part"), body(name).alias("name"), body(text).cast("binary").alias("text"))
    return rows.mapInArrow(_counted, COUNTS).groupBy("part", "name", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, scale: int) -> Column:
    """1 + floor(scale * (n + 1) / total), exact beyond 64 bits."""
    return 1 + F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(scale).cast("decimal(10,0)"), total.cast("decimal(20,0)"))


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most 10^9 + 1, so squares fit."""
    return F.call_function("div", (p - q) * (p - q), q)


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def accumulated(group: np.ndarray, term: np.ndarray, p: np.ndarray, base: np.ndarray, n_terms: int, gather: int = 1 << 20) -> np.ndarray:
    """Distances of every group from every other over the terms of a block: a row of numbers per group.

    The postings are (group, term, p); base holds each group's share of a term that it doesn't use; n_terms is the number of
    the block's terms. Sums wrap in 64 bits and come out right, since they fit.
    """
    size = len(base)
    by_term = np.argsort(term, kind="stable")  # the term-major index
    peers, shares = group[by_term], p[by_term]
    starts = np.searchsorted(term[by_term], np.arange(n_terms))
    lengths = np.append(starts[1:], len(term)) - starts
    by_group = np.argsort(group, kind="stable")
    rows = np.searchsorted(group[by_group], np.arange(size + 1))
    used = np.diff(rows)
    # how often each share occurs in each group
    kinds, times = np.unique(np.stack([group, p]), axis=1, return_counts=True) if len(p) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
    kind_of, kind_p = kinds[0], kinds[1]
    kind_rows = np.searchsorted(kind_of, np.arange(size + 1))
    out = np.zeros((size, size), np.int64)
    for g in range(size):
        acc, own = out[g], base[g]
        # terms that neither uses, then those of the group, then those of the peers
        nothing = _far(own, base)
        acc += (n_terms - used[g] - used) * nothing
        for k in range(kind_rows[g], kind_rows[g + 1]):
            acc += times[k] * _far(kind_p[k], base)
        np.add.at(acc, kind_of, times * _far(own, kind_p))
        # terms that both use: each of the group's terms scatters its postings
        mine = by_group[rows[g] : rows[g + 1]]
        reach = np.cumsum(lengths[term[mine]])
        at = 0
        while at < len(mine):
            end = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + gather, "right")))
            some, n = mine[at:end], lengths[term[mine[at:end]]]
            place = np.repeat(starts[term[some]] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            h, q, mp = peers[place], shares[place], np.repeat(p[some], n)
            np.add.at(acc, h, _far(mp, q) - _far(mp, base[h]) - _far(own, q) + nothing[h])
            at = end
    return out


def _block(table: pa.Table) -> pa.Table:
    """One block: postings, and a row without term for each group of the part."""
    term = table.column("t_term")
    facts = table.filter(term.is_null())
    postings = table.filter(term.is_valid())
    order = np.argsort(facts.column("t_group").to_numpy())
    base = facts.column("t_p").to_numpy()[order].astype(np.int64)
    terms = postings.column("t_term").combine_chunks().dictionary_encode()
    n_terms, codes = len(terms.dictionary), terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sums = accumulated(postings.column("t_group").to_numpy().astype(np.int64), codes, postings.column("t_p").to_numpy().astype(np.int64), base, n_terms)
    part = facts.column("part")[0].as_py()
    return pa.table({"part": pa.array([part] * len(base), pa.string()), "t_group": pa.array(np.arange(len(base)), pa.int32()), "sums": pa.array(list(sums), pa.list_(pa.int64()))})


class Audit:
    """Counts of a table, and the results made of them; the counts are written once and read by both."""

    def __init__(self, docs: DataFrame, part: str = "lang", name: str = "source", text: str = "text", least_docs: int = 3, scale: int = 10**9):
        body = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        self.scale = scale
        counts = written(term_counts(docs, part, name, text), "divergence-counts")
        totals = counts.groupBy("part", "term").agg(F.sum("n").alias("t_n"), F.sum("docs").alias("t_docs")).where(F.col("t_docs") >= least_docs)
        #: part, name, term, n and t_n (the part's occurrences) of kept terms
        self.kept = written(counts.join(totals.select("part", "term", "t_n"), ["part", "term"]), "divergence-kept")
        parts = self.kept.groupBy("part", "term").agg(F.first("t_n").alias("t_n")).groupBy("part").agg(F.count("*").alias("t_v"), F.sum("t_n").alias("t_total"))
        sizes = self.kept.groupBy("part", "name").agg(F.sum("n").alias("t_own"), F.count("*").alias("t_rows"))
        groups = docs.select(body(part).alias("part"), body(name).alias("name")).distinct().join(sizes, ["part", "name"], "left").join(parts, "part", "left")
        groups = groups.fillna(0, ["t_own", "t_rows", "t_v", "t_total"])
        number = F.row_number().over(Window.partitionBy("part").orderBy("name")) - 1
        blocks = F.greatest(F.ceil(F.sum("t_rows").over(Window.partitionBy("part")) / BLOCK), F.lit(1)).cast("int")
        #: a row per group: its number, the part's blocks, V and total, its own total, and its share of a term that it doesn't use
        groups = groups.withColumns({"t_group": number, "t_blocks": blocks}).drop("t_rows")
        base = F.when(F.col("t_v") > 0, share(F.lit(0), F.col("t_own") + F.col("t_v"), scale)).otherwise(F.lit(1).cast("long"))
        self.groups = written(groups.withColumn("t_base", base), "divergence-groups")

    def _shares(self) -> DataFrame:
        """kept with the group's facts and both shares."""
        dealt = self.groups.withColumn("t_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
        rows = self.kept.withColumn("t_deal", F.pmod(F.xxhash64("term"), F.lit(DEALT)).cast("int")).join(dealt, ["part", "name", "t_deal"])
        return rows.withColumns({"t_p": share(F.col("n"), F.col("t_own") + F.col("t_v"), self.scale), "t_q": share(F.col("t_n"), F.col("t_total") + F.col("t_v"), self.scale)})

    def pairs(self) -> DataFrame:
        """part, name, peer and value for each two different groups of a part."""
        facts = self.groups.select("part", F.explode(F.sequence(F.lit(0), F.col("t_blocks") - 1)).alias("t_block"), "t_group", F.lit(None).cast("string").alias("t_term"), F.col("t_base").alias("t_p"))
        block = F.pmod(F.xxhash64(F.lit("block"), "term"), F.col("t_blocks")).cast("int")
        postings = self._shares().select("part", block.alias("t_block"), "t_group", F.col("term").alias("t_term"), "t_p")
        sums = postings.unionByName(facts).groupBy("part", "t_block").applyInArrow(_block, "part string, t_group int, sums array<bigint>")
        cells = sums.select("part", "t_group", F.posexplode("sums").alias("t_peer", "t_sum")).where("t_group <> t_peer")
        cells = cells.groupBy("part", "t_group", "t_peer").agg(F.sum(F.col("t_sum").cast("decimal(20,0)")).cast("long").alias("value"))
        named = self.groups.select("part", "t_group", "name")
        return cells.join(named, ["part", "t_group"]).join(named.select("part", F.col("t_group").alias("t_peer"), F.col("name").alias("peer")), ["part", "t_peer"]).select("part", "name", "peer", "value")

    def terms(self) -> DataFrame:
        """part, name, term and value of the terms that a group uses more than its part does."""
        more = self._shares().where("t_p > t_q")
        return more.select("part", "name", "term", distance(F.col("t_p"), F.col("t_q")).alias("value"))


def top_terms(terms: DataFrame, limit: int) -> DataFrame:
    """The farthest terms of each group, with rank; Spark cuts each task's rows to the limit before it shuffles them."""
    w = Window.partitionBy("part", "name").orderBy(F.desc("value"), "term")
    return terms.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
