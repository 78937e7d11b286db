"""A Merkle manifest of a table: per group a tree of digests over its rows in order, and one more tree over the groups.

A node is labelled by the interval of leaf ranks that it covers, so its place in the tree needs no pointers: intervals
nest or are apart. Of every `arity` consecutive nodes of a level one parent is made (the last ones may be fewer), until a
group has one node, its subroot; subroots, ordered by group, are the leaves of the tree above. To prove a row, nodes meet
their parent by a join on the parent's level bucket (lo div arity ** level) and containment of the intervals; what the
parent's children have besides the node's own interval are its siblings. Paths are handed down from the root, so a parent
gets its own path once for all that lies below it. No join key has more than `arity` rows on a side.

Ranks are given without one task seeing a group: rows are range partitioned by group and order, ranked inside partitions,
and moved on by the totals of the partitions before (a row per partition and group).

Edge cases: a null field counts as `-`; groups and ids may be null and come first; rows that repeat the order's columns are
ordered by their digest, and equal rows take neighbouring places; a group of one row has that row's digest as subroot; an
empty table has neither nodes nor a root (None); other columns take no part and may have any name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.shared import discard, written

NODE = ["m_group", "m_n", "lo", "hi", "digest"]
STEP = "array<struct<left:string,right:string>>"
#: Repeated rows are dealt to so many places of the range partitioning at most.
DEALT = 1 << 20


def field(c: Column) -> Column:
    """A field as it enters a digest: `-` for null, else its number of UTF-8 bytes, a colon and its text."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows with m_n, the size of their m_group, and lo and hi, both their rank in it by order, from 0."""
    dealt = rows.withColumn("m_tie", F.pmod(F.monotonically_increasing_id(), F.lit(DEALT)))
    dealt = written(dealt.repartitionByRange("m_group", *order, "m_tie").withColumn("m_part", F.spark_partition_id()), "merkle-dealt")
    counts = dealt.groupBy("m_part", "m_group").agg(F.count("*").alias("m_rows"))
    w = Window.partitionBy("m_group")
    ahead = F.sum("m_rows").over(w.orderBy("m_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("m_part", "m_group", F.coalesce(ahead, F.lit(0)).alias("m_ahead"), F.sum("m_rows").over(w).alias("m_n"))
    inside = F.row_number().over(Window.partitionBy("m_part", "m_group").orderBy(*order, "m_tie"))
    out = dealt.withColumn("m_inside", inside).join(counts, ["m_part", "m_group"])
    out = out.withColumn("lo", F.col("m_ahead") + F.col("m_inside") - 1).withColumn("hi", F.col("lo"))
    out = written(out.drop("m_tie", "m_part", "m_inside", "m_ahead"), "merkle-leaves")
    discard(dealt)
    return out


def levels(leaves: DataFrame, arity: int) -> list[DataFrame]:
    """The nodes above leaves, level by level, each with its children; a group's last node covers all its ranks."""
    largest = leaves.agg(F.max("m_n")).first()[0] or 0
    out, now, width = [], leaves.select(*NODE), 1
    while largest > width:
        bucket = F.expr(f"lo div {width * arity}")
        found = now.where(F.col("m_n") > width).groupBy("m_group", "m_n", bucket.alias("m_bucket"))
        found = found.agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))  # arity rows at most
        joined = F.sha2(F.array_join(F.transform("children", lambda c: c["digest"]), ""), 256)
        now = found.select("m_group", "m_n", F.element_at("children", 1)["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi"), joined.alias("digest"), "children")
        now = written(now, "merkle-level")
        out.append(now)
        width *= arity
    return out


@dataclass(frozen=True)
class Forest:
    """Trees of several groups: leaves with ranks, and the levels above them."""

    leaves: DataFrame
    above: list[DataFrame]
    arity: int

    def roots(self) -> DataFrame:
        """m_group, m_n, digest of the node that covers a group."""
        tops = [t.where("lo = 0 AND hi = m_n - 1").select("m_group", "m_n", "digest") for t in (self.leaves, *self.above)]
        return reduce(DataFrame.union, tops)

    def paths(self, tops: DataFrame) -> DataFrame:
        """leaves with path: left and right siblings' digests from each level, from the leaf up.

        tops (m_group, m_n, path, root) says how a group's own root goes on upwards; root is handed down too.
        """
        parents, width = None, self.arity ** len(self.above)
        for nodes in (*reversed(self.above), self.leaves):
            # roots of this level have no parent: they stand for themselves, without siblings
            own = tops.where((F.col("m_n") <= width) & (F.col("m_n") * self.arity > width) if width > 1 else F.col("m_n") == 1)
            own = own.select("m_group", F.lit(0).cast("long").alias("p_lo"), (F.col("m_n") - 1).alias("p_hi"), F.lit(None).cast(f"array<struct<lo:bigint,hi:bigint,digest:string>>").alias("p_children"), F.col("path").alias("p_path"), "root")
            out = _attached(nodes, own if parents is None else parents.unionByName(own), width * self.arity)
            if nodes is not self.leaves:
                # each level is written, so plans stay small however high the trees are
                before, parents = parents, written(out.select("m_group", F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("children").alias("p_children"), F.col("path").alias("p_path"), "root"), "merkle-paths")
                discard(*([] if before is None else [before]))
            width //= self.arity
        return out


def _attached(nodes: DataFrame, parents: DataFrame, width: int) -> DataFrame:
    """nodes with the path of the parent that contains them, their own siblings before it."""
    parents = parents.withColumn("p_bucket", F.expr(f"p_lo div {width}")).withColumnRenamed("m_group", "p_group")
    inside = (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi"))
    met = nodes.withColumn("m_bucket", F.expr(f"lo div {width}"))
    met = met.join(parents, (F.col("m_group") == F.col("p_group")) & (F.col("m_bucket") == F.col("p_bucket")) & inside)
    side = lambda keep: F.array_join(F.transform(F.filter("p_children", keep), lambda c: c["digest"]), "")
    step = F.struct(side(lambda c: c["hi"] < F.col("lo")).alias("left"), side(lambda c: c["lo"] > F.col("hi")).alias("right"))
    path = F.when(F.col("p_children").isNull(), F.col("p_path")).otherwise(F.concat(F.array(step), F.col("p_path")))
    return met.select(*nodes.columns, path.alias("path"), "root")


@dataclass(frozen=True)
class Manifest:
    """The trees of the groups, the tree over their roots, and its root (None of an empty table)."""

    groups: Forest
    top: Forest
    root: str | None

    def nodes(self) -> DataFrame:
        """m_group (null for the tree over the groups), level, lo, hi and digest of every node: what is stored as manifest."""
        tables = []
        for forest in (self.groups, self.top):
            group = F.col("m_group") if forest is self.groups else F.lit(None).cast(self.groups.leaves.schema["m_group"].dataType)
            tables += [t.select(group.alias("m_group"), F.lit(k).alias("level"), "lo", "hi", "digest") for k, t in enumerate((forest.leaves, *forest.above))]
        return reduce(DataFrame.union, tables)

    def proofs(self) -> DataFrame:
        """The leaves with subroot and path, the steps from the leaf through its subroot to the root."""
        nothing = F.array().cast(STEP)
        tops = self.top.paths(self.top.roots().select("m_group", "m_n", nothing.alias("path"), F.col("digest").alias("root")))
        sizes = self.groups.roots().select("m_group", "m_n", F.col("digest").alias("root"))
        on = tops.select(F.col("group").alias("m_group"), "path")
        return self.groups.paths(sizes.join(on, "m_group")).withColumnRenamed("root", "subroot")

    def discard(self) -> None:
        """Delete the trees, once nothing reads them any more."""
        discard(*(t for forest in (self.groups, self.top) for t in (forest.leaves, *forest.above)))


def build(rows: DataFrame, fields: Sequence[str], group: Sequence[str], order: Sequence[str], arity: int = 8, carry: Mapping[str, Column] | None = None) -> Manifest:
    """The manifest of rows: leaves digest the fields, and stand per group in order. carry: further columns of the leaves."""
    own = {f"k_{i}": F.col(c) for i, c in enumerate(order)}
    leaves = rows.select(F.struct(*(F.col(c).alias(f"g{i}") for i, c in enumerate(group))).alias("m_group"), digest([F.col(c) for c in fields]).alias("digest"), *(c.alias(n) for n, c in {**own, **(carry or {})}.items()))
    raw = written(leaves, "merkle-rows")
    leaves = ranked(raw, [*own, "digest"])
    groups = Forest(leaves, levels(leaves, arity), arity)
    discard(raw)
    above = written(groups.roots().select(F.struct(F.lit(0).alias("g0")).alias("m_group"), F.col("m_group").alias("group"), "digest"), "merkle-roots")
    subroots = ranked(above, ["group"])
    discard(above)
    top = Forest(subroots, levels(subroots, arity), arity)
    root = top.roots().first()
    return Manifest(groups, top, root and root["digest"])


def differences(before: Manifest, after: Manifest) -> DataFrame:
    """m_group, rank, before and after: digests of the leaves that two manifests of one arity don't share (null where one has none).

    The trees are compared from their roots down, and a level's nodes only below intervals that differ above, by the same
    bucketed containment join. A row put in moves those behind it, which then differ too.
    """
    a, b = before.groups, after.groups
    tables = [[f.leaves, *f.above] for f in (a, b)]
    found, key = None, ["m_group", "lo", "hi"]
    for level in reversed(range(max(map(len, tables)))):
        mine, theirs = ((t[level] if level < len(t) else t[0].limit(0)).select(*key, F.col("digest").alias(n)) for t, n in zip(tables, ("before", "after")))
        both = mine.join(theirs, key, "full").where(~F.col("before").eqNullSafe(F.col("after")))
        if found is not None:
            width = a.arity ** (level + 1)
            above = found.select(F.col("m_group").alias("p_group"), F.expr(f"lo div {width}").alias("p_bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"))
            # the last node of a level may end elsewhere in the other tree, where a group's size differs: both are above
            inside = (F.col("p_lo") <= F.col("lo")) & (F.col("lo") <= F.col("p_hi"))
            below = both.join(above, (F.col("m_group") == F.col("p_group")) & (F.expr(f"lo div {width}") == F.col("p_bucket")) & inside, "left_semi")
            # groups that had no node as high as that begin here
            both = below.union(both.join(above.select("p_group").distinct(), F.col("m_group") == F.col("p_group"), "left_anti"))
        found = written(both, "merkle-differences")
    return found.select("m_group", F.col("lo").alias("rank"), "before", "after")


def proof(path: Column) -> Column:
    """One digest of all siblings on a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))
