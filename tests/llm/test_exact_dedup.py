"""Exact dedup against a plain grouping of the normalised texts, with hashes of any quality."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from barloom.llm import exact_dedup

ROWS = [(1, "a  b"), (None, "a b"), (1, "a  b"), (1, "a\tb"), (2, None), (3, ""), (None, "z"), (None, "z"), (0, " "), (5, "q"), (7, " q"), (8, "\n q"), (9, "q\u00a0"), (10, "Q"), (4, "long " * 60_000), (6, "long\n" * 60_000), (11, "\x00")]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    out = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha, stays = hashlib.sha256(t.encode()).hexdigest(), True
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            out[(i, keep, len(ids), stays and i == keep, sha)] += 1
            stays = stays and i != keep
    return out


@pytest.mark.parametrize("bits", ["all", "eight", "none"])
def test_exact_dedup(spark, bits):
    """A weak hash puts many texts into one group, and their bytes tell them apart."""
    digest = {"all": exact_dedup.md5, "eight": lambda c: F.unhex(F.substring(F.md5(c), 1, 2)), "none": lambda c: F.unhex(F.lit("00"))}[bits]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(*r, k, k, k, k) for k, r in enumerate(ROWS)], "doc_id long, text string, keep_id int, x_hash int, x_times int, kept int")
    for table in (docs, odd):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        found = exact_dedup.judge(table, digest=digest).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found) == brute(rows)
        left = exact_dedup.dedup(table, digest=digest)
        assert left.columns == table.columns
        stays = lambda i, t: (i, hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", t or "").encode()).hexdigest())
        assert Counter(stays(r.doc_id, r.text) for r in left.collect()) == Counter((k[0], k[4]) for k, n in brute(rows).items() for _ in range(n) if k[3])
    assert exact_dedup.judge(odd.limit(0), digest=digest).count() == exact_dedup.dedup(odd.limit(0), digest=digest).count() == 0


def test_no_task_gets_a_class_of_a_third(spark):
    """A class that holds half of all rows goes through the broadcast, so its rows aren't dealt by hash."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "the same").otherwise(F.concat(F.lit("other "), F.col("id").cast("string"))).alias("text"))
    judged = exact_dedup.judge(docs)
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert judged.where("group_size = 2000").count() == 2000 and judged.where("kept").count() == 2001
    assert "LeftAnti" in plan and "strategy=broadcast" in plan
