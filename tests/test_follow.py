"""A followed stream equals the batch plan, across restarts, disorder and late bars."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators import frames, replay
from barloom.streaming import follow

BARS = "htsc_code string, time timestamp, close double, buy boolean, sell boolean"


@pytest.fixture
def provider(spark):
    before = spark.conf.get(follow.PROVIDER[0])
    spark.conf.set(*follow.PROVIDER)
    yield
    spark.conf.set(follow.PROVIDER[0], before)


def test_stream_equals_batch_after_a_restart(spark, tmp_path, provider):
    rng, start, rows = random.Random(8), datetime(2022, 1, 3), []
    for code in ("A", "B", "C"):
        c = 10.0
        for k in range(60):
            c *= rng.choice([0.88, 0.95, 1.0, 1.04, 1.09])
            if rng.random() < 0.8:
                rows.append((code, start + timedelta(k), round(c, 3) if rng.random() < 0.95 else 0.0, rng.random() < 0.4, rng.random() < 0.2))
    rows.sort(key=lambda r: (r[1] + timedelta(rng.choice([0, 0, 1, 2])), r[0]))  # two days of disorder
    end = [("Z", start + timedelta(k), 1.0, False, False) for k in (200, 300)]
    late = [("A", start + timedelta(1, 3600), 99.0, True, True)]
    at, out = str(tmp_path / "in"), str(tmp_path / "out")

    def put(part):
        spark.createDataFrame(part, BARS).coalesce(1).write.mode("append").parquet(at)

    def run():
        stream = spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(at)
        q = follow.follow(stream, 1000.0).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start(out)
        assert q.awaitTermination(240)

    put(rows[:60])
    put(rows[60:90])
    run()
    first = spark.read.parquet(out).count()
    put(rows[90:])
    put([*late, end[0]])
    put(end[1:])
    run()  # goes on from the checkpoint: positions, ordinals and waiting bars are kept
    got = {(r.htsc_code, r.time): (r.close, r.bar, r.tradable, r.side, r.executed_size, r.position_after) for r in spark.read.parquet(out).where("htsc_code <> 'Z'").collect()}
    assert 0 < first < len(got)

    batch = frames.move_gate(spark.createDataFrame(rows, BARS))
    batch = batch.withColumn("tradable", F.coalesce("tradable", F.lit(True)))
    log = {(r.code, r.date): (r.side, r.executed_size) for r in replay.orders(batch, F.col("buy") & F.col("tradable"), F.col("sell") & F.col("tradable"), 1000.0).collect()}
    gate = {(r.htsc_code, r.time): r.tradable for r in batch.collect()}
    assert set(got) == set(gate) and {k: v[2] for k, v in got.items()} == gate
    assert {k: v[3:5] for k, v in got.items() if v[3]} == log and len(log) > 10
    for code in "ABC":
        own = sorted(k for k in got if k[0] == code)
        assert [got[k][1] for k in own] == list(range(1, len(own) + 1))
