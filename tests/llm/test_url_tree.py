"""The tree of templates against the same rules level by level in Python, on wide, deep and comb-like trees."""

from __future__ import annotations

import math
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from barloom.llm import url_filter

SCHEMA = "host string, template array<string>, n long, labelled long, bad long"


def brute(rows, rules):
    """host, template -> node."""
    nodes = {(h, tuple(t)): list(t) for h, t, *_ in rows}
    said = {(h, tuple(t)): (n, b) for h, t, _, n, b in rows}
    for level in range(max((len(t) for _, t in nodes), default=0)):
        n, b = Counter(), Counter()
        for k, node in nodes.items():
            if len(node) > level:
                key = (k[0], tuple(node[:level]), node[level])
                n[key] += said[k][0]
                b[key] += said[k][1]
        all_n, all_b = defaultdict(int), defaultdict(int)
        for k in n:
            all_n[k[:2]] += n[k]
            all_b[k[:2]] += b[k]
        def alike(n1, b1, n2, b2, share):
            return abs(b1 / max(n1, 1) - b2 / max(n2, 1)) <= rules.merge_z * math.sqrt(share * (1 - share) * (1 / max(n1, 1) + 1 / max(n2, 1)))

        named, others = {}, defaultdict(list)
        for k in n:
            rest, rest_b = all_n[k[:2]] - n[k], all_b[k[:2]] - b[k]
            if n[k] < rules.own and (n[k] == 0 or rest == 0 or alike(n[k], b[k], rest, rest_b, all_b[k[:2]] / max(all_n[k[:2]], 1))):
                named[k] = "*"
            else:
                others[k[:2]].append(k)
        for ks in others.values():
            cell = {k: 1000 * b[k] // max(n[k], 1) for k in ks}
            runs = []  # of cells, with their sums
            for c in sorted(set(cell.values())):
                cn, cb = (sum(of[k] for k in ks if cell[k] == c) for of in (n, b))
                if runs and alike(cn, cb, runs[-1][1], runs[-1][2], (cb + runs[-1][2]) / (cn + runs[-1][1])):
                    runs[-1] = (runs[-1][0] | {c}, cn + runs[-1][1], cb + runs[-1][2])
                else:
                    runs.append(({c}, cn, cb))
            for number, (run, *_) in enumerate(runs, 1):
                members = [k for k in ks if cell[k] in run]
                named |= {k: f"*{number}" for k in members if len(members) > 1}
        for node, k in [(node, (h, tuple(node[:level]), node[level])) for (h, _), node in nodes.items() if len(node) > level]:
            node[level] = named.get(k, node[level])
    return {k: "/".join(v) for k, v in nodes.items()}


def drawn(seed):
    rng, paths = random.Random(seed), set()
    for host in ("a", "b"):
        for _ in range(60):
            paths.add((host, tuple(rng.choices("xyz", weights=[8, 2, 1], k=rng.randrange(0, 7)))))
        for k in range(0, 40, rng.choice([1, 3])):  # a comb, and a fork at its end
            paths.add((host, ("trap",) * k))
        paths |= {(host, ("trap",) * 45 + (c, "end")) for c in "pq"} | {(host, ("lone", *map(str, range(30))))}
    return [(h, list(t), n, n, rng.randrange(0, n + 1)) for h, t in sorted(paths) for n in [rng.choice([0, 0, 1, 2, 5, 30])]]


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_equals_level_by_level(spark, seed):
    rows, rules = drawn(seed), url_filter.TreeRules()
    found = url_filter.tree(spark.createDataFrame(rows, SCHEMA), rules)
    assert {(r.host, tuple(r.template)): r.node_key for r in found.collect()} == brute(rows, rules)


def test_alike_branches_with_many_labels_merge(spark):
    """Two half bad ones and two good ones, of 30 labelled pages and more each, and a bad one by itself; what is below meets."""
    branches = {"a": (30, 15), "b": (40, 19), "c": (60, 1), "d": (50, 0), "e": (50, 49)}
    rows = [("h", [name, "x"], n, n, bad) for name, (n, bad) in branches.items()]
    found = {r.template[0]: r for r in url_filter.tree(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: r.node_key for k, r in found.items()} == {"a": "*2/x", "b": "*2/x", "c": "*1/x", "d": "*1/x", "e": "e/x"}
    assert found["a"].share == found["b"].share and found["c"].share == found["d"].share
    assert {k for k, r in found.items() if r.reject} == {"e"}


def test_a_crawlers_trap(spark):
    """Urls of 2,000 segments, and one that ends after each of 300, in a few rounds."""
    pages = [(k, f"http://trap.example/{'next/' * 2000}{k}") for k in range(3)] + [(100 + k, f"http://comb.example/{'on/' * k}") for k in range(300)]
    labels = [(k, k % 2 == 0) for k in range(100, 400, 7)]
    began = time.time()
    judged = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad boolean"), [])
    assert judged.count() == 303 and time.time() - began < 90
    one = judged.where("page_id = 1").first()
    assert one.template == "/".join(["*"] * 2001) and judged.where(F.col("host") == "comb.example").count() == 300
