"""URL filters: hand-made rules first, then a tree of path templates per host, in DataFrame functions only.

A path's segments are generalised (digit runs and long hexadecimal names become wildcards). Then, level by level as deep
as the paths go, the children of a node that have few labelled pages and whose labelled purity does not differ
significantly from that of the rest of their siblings are replaced by one wildcard, under which their branches meet and
share their counts. The other children, however many pages they have, are taken in order of their purity, and each joins
the ones before it unless it differs significantly from these together; joined ones become a numbered wildcard (`*1`, which
no segment is called, since digits are generalised). Levels at which a node has one child, as in a crawler's trap,
are passed at once, so rounds are as many as the branchings that a path meets. A template's share of bad pages is smoothed towards its
host's, and the host's towards that of all pages; a page is blocked if its template's share is high.

Pages are counted per (host, template) before anything else, with partial sums in every task, so a host with a third
of all pages is one row per template. Siblings are summed by partial aggregates too, and come together by thousandths of
their purity, so a node's sequence has at most 1,001 entries however many children it has. Each
round is written, so the plan does not grow with depth.

Edge cases: a null url, or one without ://, has an empty host and path and is judged by the empty template; labels
that name no page, or name a page twice, add no page (any bad label makes a page bad); repeated pages count each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.shared import discard, written


@dataclass(frozen=True)
class TreeRules:
    """How the tree is built and judged."""

    #: A child with so many labelled pages is judged by them.
    own: int = 20
    #: Branches whose shares differ by no more than so many standard errors are alike.
    merge_z: float = 1.96
    #: Weight of the prior in labelled pages.
    prior: float = 5.0
    #: A template goes from this smoothed share of bad pages on.
    reject: float = 0.5


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruling(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of the rules (verdict, domain/path) that fits, and its verdict; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{start}")
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def template(path: Column) -> Column:
    """The path's segments, generalised, as an array."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(x.rlike("^[0-9a-fA-F-]{16,}$"), F.lit("*")).otherwise(F.regexp_replace(x, "[0-9]+", "#")))


def _spines(active: DataFrame, own: int) -> DataFrame:
    """active rows with `at` moved past the levels at which all rows of their node that go on have the same segment.

    Such an only child is pooled if it has few labelled pages, and their number falls with depth as paths end, so a chain is
    kept up to one level and pooled behind it. A node is a host, a level and what is above it.
    """
    node = ["host", "at", "above"]
    placed = active.withColumn("above", F.array_join(F.slice("node", F.lit(1), F.col("at")), "/"))
    met = placed.join(placed.groupBy(*node).agg(F.max("node").alias("last")), node)
    size, apart = F.size("node"), F.array_position(F.zip_with("node", "last", lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    met = met.withColumn("shared", F.when(apart == 0, size).otherwise(apart - 1).cast("int"))
    ends = met.groupBy(*node).agg(F.coalesce(F.min(F.when(F.col("shared") < size, F.col("shared"))), F.max(F.size("last"))).alias("spine"))
    met = met.drop("last", "shared").join(ends, node)
    lengths = met.groupBy(*node, "spine", F.least(size, F.col("spine")).alias("length")).agg(F.sum("labelled").alias("labelled"))
    lengths = lengths.groupBy(*node, "spine").agg(F.collect_list(F.struct("length", "labelled")).alias("lengths"))  # one for each length of a path at most
    behind = lambda level: F.aggregate(F.filter("lengths", lambda e: e["length"] > level), F.lit(0).cast("long"), lambda acc, e: acc + e["labelled"])
    few = F.array_min(F.filter(F.concat(F.array("at"), F.transform("lengths", lambda e: e["length"])), lambda level: behind(level) < own))
    cuts = lengths.select(*node, F.least(F.coalesce(few, F.col("spine")), F.col("spine")).alias("cut"))
    met = met.join(cuts, node)
    stars = F.array_repeat(F.lit("*"), F.greatest(F.least(size, F.col("spine")) - F.col("cut"), F.lit(0)))
    wide = F.concat(F.slice("node", F.lit(1), F.col("cut")), stars, F.slice("node", F.col("spine") + 1, F.greatest(size - F.col("spine"), F.lit(0))))
    return met.withColumns({"node": wide, "at": F.col("spine")}).select(*active.columns)


def _alike(n: Column, bad: Column, other_n: Column, other_bad: Column, z: float) -> Column:
    """Whether two shares of bad pages do not differ significantly."""
    n, other_n = F.greatest(n, F.lit(1)), F.greatest(other_n, F.lit(1))
    share = (bad + other_bad) / F.greatest(n + other_n, F.lit(1))
    return F.abs(bad / n - other_bad / other_n) <= z * F.sqrt(share * (1 - share) * (1 / n + 1 / other_n))


def _merged(children: DataFrame, node: list[str], z: float) -> DataFrame:
    """node, here -> segment of the children that are merged with others: a wildcard for each run of alike ones."""
    celled = children.withColumn("cell", F.expr("1000 * bad div greatest(labelled, 1)"))
    cells = celled.groupBy(*node, "cell").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b"), F.count("*").alias("children"))
    runs = cells.groupBy(*node).agg(F.sort_array(F.collect_list(F.struct("cell", "n", "b", "children"))).alias("cells"))  # at most 1,001

    def step(run: Column, cell: Column) -> Column:
        joins = _alike(cell["n"], cell["b"], run["n"], run["b"], z)
        longer = F.struct((run["n"] + cell["n"]).alias("n"), (run["b"] + cell["b"]).alias("b"), run["starts"].alias("starts"))
        return F.when(joins, longer).otherwise(F.struct(cell["n"].alias("n"), cell["b"].alias("b"), F.concat(run["starts"], F.array(cell["cell"])).alias("starts")))

    first = F.element_at("cells", 1)
    run = F.aggregate(F.slice("cells", F.lit(2), F.size("cells")), F.struct(first["n"].alias("n"), first["b"].alias("b"), F.array(first["cell"]).alias("starts")), step)
    parts = runs.withColumn("starts", run["starts"]).select(*node, "starts", F.explode("cells").alias("c")).select(*node, "c.cell", "c.children", F.size(F.filter("starts", lambda x: x <= F.col("c.cell"))).alias("run"))
    met = parts.withColumn("members", F.sum("children").over(Window.partitionBy(*node, "run"))).where("members > 1")
    return celled.join(met, [*node, "cell"]).select(*node, "here", F.concat(F.lit("*"), F.col("run").cast("string")).alias("segment"))


def _branched(active: DataFrame, rules: TreeRules) -> DataFrame:
    """active rows one level on: children of a node that are few and like their siblings are pooled, others merged."""
    node = ["host", "at", "above"]
    sums = [F.sum(c).alias(c) for c in ("labelled", "bad")]
    placed = active.withColumns({"above": F.array_join(F.slice("node", F.lit(1), F.col("at")), "/"), "here": F.get("node", F.col("at"))})
    children = placed.groupBy(*node, "here").agg(*sums)
    siblings = children.groupBy(*node).agg(F.sum("labelled").alias("all_n"), F.sum("bad").alias("all_bad"))
    n, rest_n, rest_bad = F.col("labelled"), F.col("all_n") - F.col("labelled"), F.col("all_bad") - F.col("bad")
    share = F.col("all_bad") / F.greatest("all_n", F.lit(1))
    error = F.sqrt(share * (1 - share) * (1 / F.greatest(n, F.lit(1)) + 1 / F.greatest(rest_n, F.lit(1))))
    gap = F.abs(F.col("bad") / F.greatest(n, F.lit(1)) - rest_bad / F.greatest(rest_n, F.lit(1)))
    alike = (n == 0) | (rest_n == 0) | (gap <= rules.merge_z * error)
    told = children.join(siblings, node).withColumn("pooled", (n < rules.own) & alike)
    pooled = told.where("pooled").select(*node, "here", F.lit("*").alias("segment"))
    renamed = pooled.unionByName(_merged(told.where("NOT pooled"), node, rules.merge_z))
    wide = F.concat(F.slice("node", F.lit(1), F.col("at")), F.array("segment"), F.slice("node", F.col("at") + 2, F.size("node")))
    out = placed.join(renamed, [*node, "here"], "left").withColumn("node", F.when(F.col("segment").isNotNull(), wide).otherwise(F.col("node")))
    return out.withColumn("at", F.col("at") + 1).select(*active.columns)


def tree(counts: DataFrame, rules: TreeRules = TreeRules()) -> DataFrame:
    """host, template -> reject, from counts (host, template, n, labelled, bad) per host and template."""
    nodes = written(counts.withColumns({"node": F.col("template"), "at": F.lit(0)}), "url-nodes")
    sums = [F.sum(c).alias(c) for c in ("labelled", "bad")]
    more = F.size("node") > F.col("at")
    # a round for each branching that a path meets, however deep it goes
    while not nodes.where(more).isEmpty():
        straight = written(nodes.where(~more).unionByName(_spines(nodes.where(more), rules.own)), "url-nodes")
        discard(nodes)
        nodes = written(straight.where(~more).unionByName(_branched(straight.where(more), rules)), "url-nodes")
        discard(straight)
    nodes = nodes.withColumn("node_key", F.array_join("node", "/"))

    leaves = nodes.groupBy("host", "node_key").agg(*sums)
    everyone = leaves.agg(*sums).first()
    overall = (everyone["bad"] or 0) / everyone["labelled"] if everyone["labelled"] else 0.0
    hosts = nodes.groupBy("host").agg(F.sum("labelled").alias("h_labelled"), F.sum("bad").alias("h_bad"))
    a = rules.prior
    host_share = (F.col("h_bad") + a * overall) / (F.col("h_labelled") + a)
    judged = leaves.join(hosts, "host").withColumn("share", (F.col("bad") + a * host_share) / (F.col("labelled") + a))
    judged = judged.select("host", "node_key", "share", (F.col("share") >= rules.reject).alias("reject"))
    return nodes.join(judged, ["host", "node_key"]).select("host", "template", "node_key", "share", "reject")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], settings: TreeRules = TreeRules(), id_column: str = "page_id", url: str = "url") -> DataFrame:
    """page id, host, path, rule, verdict, template and its smoothed share of every row of pages.

    labels: (the pages' id column, bad boolean).
    """
    seen = pages.select(F.col(id_column).alias("page"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    seen = seen.withColumn("template", template(F.col("path")))
    known = labels.groupBy(F.col(id_column).alias("page")).agg(F.max(F.col("bad").cast("int")).alias("bad"))
    counts = seen.join(known, "page", "left").groupBy("host", "template").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    out = seen.join(tree(counts, settings), ["host", "template"])
    name, verdict = ruling(F.col("host"), F.col("path"), rules)
    by_tree = F.when(F.col("reject"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(
        F.col("page").alias(id_column), "host", "path", name.alias("rule"), F.coalesce(verdict, by_tree).alias("verdict"),
        F.col("node_key").alias("template"), F.col("share").alias("bad_share"),
    )
