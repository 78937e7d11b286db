"""The manifest against a plain tree built in Python, on every size around the powers of the arity."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from barloom.llm import merkle

SCHEMA = "doc_id long, lang string, text string, path int, digest int, m_group int, root string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(digests, arity):
    """The root, and for each leaf its steps (left, right)."""
    steps, now = [[] for _ in digests], list(digests)
    at = list(range(len(digests)))
    while len(now) > 1:
        for k, place in enumerate(at):
            run = now[place - place % arity : place - place % arity + arity]
            steps[k].append(("".join(run[: place % arity]), "".join(run[place % arity + 1 :])))
        now = [H(*now[i : i + arity]) for i in range(0, len(now), arity)]
        at = [p // arity for p in at]
    return now[0], steps


def brute(rows, arity):
    groups = defaultdict(list)
    for i, lang, text in rows:
        groups[lang].append((i is not None, i or 0, H(field(i), field(lang), field(text))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([d for *_, d in sorted(groups[g])], arity) for g in order}
    root, tops = tree([trees[g][0] for g in order], arity)
    out = Counter()
    for g, top in zip(order, tops):
        for (known, i, d), steps in zip(sorted(groups[g]), trees[g][1]):
            out[(i if known else None, d, trees[g][0], tuple(steps + top))] += 1
    return root, out


def rows_of(sizes):
    return [(k, g, f"text {k} of {g}") for g, n in sizes.items() for k in range(n)]


@pytest.mark.parametrize("arity,rows", [
    (2, rows_of({"a": 1, "b": 2, "c": 3, None: 4, "": 5, "ä": 17})),
    (3, rows_of({"x": 27, "y": 28, "z": 26})),
    (8, rows_of({"one": 64, "two": 65, None: 9}) + [(None, "one", None), (None, "one", "x"), (5, "one", ""), (5, "one", ""), (5, "one", "y" * 300_000)]),
    (8, rows_of({"alone": 1})),
    (8, rows_of({"alone": 8})),
    (8, [(3, "same", "row")] * 300 + [(4, "same", "other")]),
])
def test_manifest(spark, arity, rows):
    table = spark.createDataFrame([(*r, 1, 2, 3, "r") for r in rows], SCHEMA).repartition(3)
    manifest = merkle.build(table, ["doc_id", "lang", "text"], ["lang"], ["doc_id"], arity, {"doc_id": F.col("doc_id")})
    root, expect = brute(rows, arity)
    found = manifest.proofs().withColumns({"proof": merkle.proof(F.col("path")), "folded": merkle.folded(F.col("digest"), F.col("path")), "wrong": merkle.folded(F.sha2(F.lit("no"), 256), F.col("path"))}).collect()
    assert manifest.root == root
    assert Counter((r.doc_id, r.digest, r.subroot, tuple(map(tuple, r.path))) for r in found) == expect
    assert all(r.folded == root and r.wrong != root and r.proof == H(*(x for s in r.path for x in s)) for r in found)
    manifest.discard()


def test_intervals_nest(spark):
    """Nodes of a level are apart and cover every rank; each lies in one of the level above; the levels end in one node."""
    table = spark.createDataFrame([(*r, 1, 2, 3, "r") for r in rows_of({"a": 700, "b": 8})], SCHEMA)
    manifest = merkle.build(table, ["doc_id"], ["lang"], ["doc_id"])
    levels = defaultdict(list)
    for r in manifest.nodes().where("m_group.g0 = 'a'").collect():
        levels[r.level].append((r.lo, r.hi))
    assert sorted(levels) == [0, 1, 2, 3, 4] and [len(levels[k]) for k in range(5)] == [700, 88, 11, 2, 1]
    for k, spans in levels.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == 699 and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))
        if k:
            assert all(sum(lo <= a and b <= hi for lo, hi in spans) == 1 for a, b in levels[k - 1])


def test_repeats_are_dealt(spark, monkeypatch):
    """Ranks are given in many partitions even if all rows are the same, and then are 0 to n - 1."""
    rows = spark.range(20_000).select(F.struct(F.lit("g").alias("g0")).alias("m_group"), F.lit("d").alias("digest")).repartition(4)
    dealt = []
    monkeypatch.setattr(merkle, "discard", lambda *tables: dealt.extend(tables))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one partition
    try:
        found = merkle.ranked(rows, ["digest"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.agg(F.min("lo"), F.max("lo"), F.countDistinct("lo")).first()[:] == (0, 19_999, 20_000)
    assert max(r["count"] for r in dealt[0].groupBy("m_part").count().collect()) < 10_000


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    manifest = merkle.build(none, ["doc_id", "text"], ["lang"], ["doc_id"])
    assert manifest.root is None and manifest.proofs().count() == manifest.nodes().count() == 0


def test_differences(spark):
    """Changed, added and dropped rows, in groups of different heights; equal tables differ nowhere."""
    rows = [(k, g, f"text {k}") for g, n in (("a", 300), ("b", 9), ("c", 1), ("same", 70)) for k in range(n)]
    other = [(i, g, t.upper() if (g, i) in {("a", 7), ("a", 299), ("b", 8), ("c", 0)} else t) for i, g, t in rows]
    other += [(300, "a", "new"), (0, "d", "new group")]
    other.remove((8, "b", "TEXT 8"))
    built = [merkle.build(spark.createDataFrame([(*r, 1, 2, 3, "r") for r in x], SCHEMA), ["doc_id", "text"], ["lang"], ["doc_id"]) for x in (rows, other)]
    leaves = [{(r.m_group.g0, r.lo): r.digest for r in m.groups.leaves.collect()} for m in built]
    expect = {(k, leaves[0].get(k), leaves[1].get(k)) for k in leaves[0].keys() | leaves[1].keys() if leaves[0].get(k) != leaves[1].get(k)}
    got = {((r.m_group.g0, r["rank"]), r.before, r.after) for r in merkle.differences(*built).collect()}
    assert got == expect and {k for k, *_ in got} == {("a", 7), ("a", 299), ("a", 300), ("b", 8), ("c", 0), ("d", 0)}
    assert merkle.differences(built[0], built[0]).count() == 0
