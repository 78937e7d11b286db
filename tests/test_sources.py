"""Snapshots under failures and races; tables whose months differ; stored names; many runs in one plan; the command line."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom import api
from barloom.operators import frames
from barloom.sources import catalog, snapshots, store

ROWS = "htsc_code string, time date, close double, year string, month string"


def rows_of(spark, values):
    return spark.createDataFrame([(c, d, v, f"{d:%Y}", f"{d:%m}") for c, d, v in values], ROWS)


def seen(spark, base):
    return {(r.htsc_code, r.time): r.close for r in snapshots.read(spark, base).collect()}


JAN, FEB, MAR = date(2022, 1, 5), date(2022, 2, 5), date(2022, 3, 5)


class Killed(RuntimeError):
    pass


def test_versions(spark, tmp_path):
    base = str(tmp_path / "t")
    with pytest.raises(ValueError):
        snapshots.read(spark, base)
    assert store.upsert_curves(rows_of(spark, [("A", JAN, 1.0), ("A", FEB, 2.0)]), base) == 1
    untouched = {p for p in (tmp_path / "t/data/year=2022/month=01").rglob("*.parquet")}
    assert store.upsert_curves(rows_of(spark, [("A", FEB, 3.0), ("B", FEB, 4.0), ("A", MAR, 5.0)]), base) == 2
    assert seen(spark, base) == {("A", JAN): 1.0, ("A", FEB): 3.0, ("B", FEB): 4.0, ("A", MAR): 5.0}
    assert {r.close for r in snapshots.read(spark, base, 1).collect()} == {1.0, 2.0}
    assert {p for p in (tmp_path / "t/data/year=2022/month=01").rglob("*.parquet")} == untouched  # months that no row touches stay as they are
    assert snapshots.vacuum(spark, base) == 1 and len(seen(spark, base)) == 4
    with pytest.raises(ValueError):
        snapshots.read(spark, base, 1)


@pytest.mark.parametrize("at", ["read", "written", "drafted", "published"])
def test_killed_at_each_step(spark, tmp_path, at):
    """Before the rename the table is as it was, after it as it will be; a repeated job gives the same table."""
    base = str(tmp_path / "t")
    store.upsert_curves(rows_of(spark, [("A", JAN, 1.0), ("A", FEB, 2.0)]), base)
    before, new = seen(spark, base), rows_of(spark, [("A", JAN, 10.0), ("A", FEB, 20.0)])

    def die(step):
        if step == at:
            raise Killed(step)

    with pytest.raises(Killed):
        snapshots.upsert(new, base, store.merged_curves, die)
    after = {("A", JAN): 10.0, ("A", FEB): 20.0}
    assert seen(spark, base) == (after if at == "published" else before)
    store.upsert_curves(new, base)
    assert seen(spark, base) == after
    snapshots.vacuum(spark, base)
    assert seen(spark, base) == after and not [p for p in (tmp_path / "t/versions").iterdir() if "draft" in p.name]


@pytest.mark.parametrize("step", ["read", "written", "drafted"])
def test_two_writers(spark, tmp_path, step):
    """A writer that another one overtakes merges again with what that one published; a reader in between sees whole versions."""
    base, calls, between = str(tmp_path / "t"), [], []
    store.upsert_curves(rows_of(spark, [("A", JAN, 1.0), ("B", FEB, 2.0)]), base)

    def other(name):
        if name == step and not calls:
            calls.append(name)
            store.upsert_curves(rows_of(spark, [("C", JAN, 30.0), ("B", FEB, 40.0)]), base)
            between.append(seen(spark, base))

    assert snapshots.upsert(rows_of(spark, [("A", JAN, 100.0), ("D", FEB, 200.0)]), base, store.merged_curves, other) == 3
    assert between == [{("A", JAN): 1.0, ("C", JAN): 30.0, ("B", FEB): 40.0}]
    assert seen(spark, base) == {("A", JAN): 100.0, ("C", JAN): 30.0, ("B", FEB): 40.0, ("D", FEB): 200.0}
    assert snapshots.vacuum(spark, base) >= 2 and len(seen(spark, base)) == 4


def test_a_race_lost_for_good(spark, tmp_path, monkeypatch):
    base, turn = str(tmp_path / "t"), [0]
    monkeypatch.setattr(snapshots, "ATTEMPTS", 2)

    def other(name):
        if name == "drafted":
            turn[0] += 1
            folder = snapshots.Folder(spark, base)
            folder.write(f"versions/{turn[0]:010d}.json", "{}")

    with pytest.raises(snapshots.LostRace):
        snapshots.upsert(rows_of(spark, [("A", JAN, 1.0)]), base, store.merged_curves, other)
    assert not list((tmp_path / "t/data").rglob("*.parquet"))


# ---- tables whose months differ


def month_of(spark, base, at, columns, rows, name=None):
    spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(f"{base}/year={at:%Y}/month={at:%m}")
    if name:
        import pathlib

        folder = pathlib.Path(f"{base}/year={at:%Y}/month={at:%m}")
        newest = max((p for p in folder.glob("part-*.parquet")), key=lambda p: p.stat().st_mtime_ns)
        newest.rename(folder / name)


@pytest.fixture
def mixed(spark, tmp_path):
    base = str(tmp_path / "prices")
    month_of(spark, base, JAN, "htsc_code string, time date, close long, volume int", [(" a", JAN, 1, 5)])
    month_of(spark, base, FEB, "htsc_code string, time timestamp, close double", [("A", datetime(2022, 2, 5, 9), 2.5), ("B ", datetime(2022, 2, 5), 3.5)])
    month_of(spark, base, MAR, "time date, htsc_code string, close double, volume long, note string", [(MAR, "b", 4.5, 1 << 40, "x")])
    month_of(spark, base, date(2022, 4, 5), "htsc_code string, time date, close long, volume string", [("A", date(2022, 4, 5), 9, "many")])
    return base


def test_months_that_differ(spark, mixed):
    """A long beside a double, missing and further columns: one frame, as union by name gives it."""
    with pytest.raises(Exception, match="(?i)merge"):
        spark.read.option("mergeSchema", True).parquet(mixed)
    got = store.prices(spark, mixed, ["a", "B"], "2022-01-01", "2022-05-01")
    types = dict(got.dtypes)
    assert (types["close"], types["volume"], types["note"], types["time"]) == ("double", "string", "string", "date")
    rows = [(r.htsc_code, r.time, r.close, r.volume, r.note) for r in got.orderBy("time", "htsc_code").collect()]
    assert rows == [("A", JAN, 1.0, "5", None), ("A", FEB, 2.5, None, None), ("B", FEB, 3.5, None, None), ("B", MAR, 4.5, str(1 << 40), "x"), ("A", date(2022, 4, 5), 9.0, "many", None)]
    short = store.prices(spark, mixed, ["b"], "2022-02-01", "2022-03-31")
    assert dict(short.dtypes)["volume"] == "bigint" and short.count() == 2
    plan = short._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull" in plan and {m for f in short.inputFiles() for m in ("01", "02", "03", "04") if f"month={m}" in f} == {"02", "03"}
    with pytest.raises(ValueError):
        store.prices(spark, mixed, ["A"], "2023-01-01", "2023-02-01")


def test_catalogue(spark, mixed, tmp_path, monkeypatch):
    at = str(tmp_path / "catalogue")
    made = catalog.catalog(spark, mixed, at)
    assert made.spellings == {"A": [" a", "A"], "B": ["B ", "b"]} or {k: set(v) for k, v in made.spellings.items()} == {"A": {" a", "A"}, "B": {"B ", "b"}}
    opened = []
    real = catalog.groups
    monkeypatch.setattr(catalog, "groups", lambda *a: opened.append(a) or real(*a))
    again = catalog.catalog(spark, mixed, at)
    assert again == made and not opened  # no footer is read
    got = store.prices(spark, mixed, ["b"], "2022-01-01", "2022-05-01", known=again)
    assert sorted(r.close for r in got.collect()) == [3.5, 4.5]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "In(htsc_code, [B ,b])" in plan  # the scan gets the codes as they are spelt
    month_of(spark, mixed, date(2022, 5, 5), "htsc_code string, time date, close double", [("c", date(2022, 5, 5), 1.0)])
    newer = catalog.catalog(spark, mixed, at)
    assert "C" in newer.spellings and opened and len(list((tmp_path / "catalogue").glob("catalog-*"))) == 1


def test_wider():
    L, D, S, I = T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType()  # noqa: E741
    assert [catalog.wider(*p) for p in ((L, L), (I, L), (L, D), (S, D), (T.DateType(), T.TimestampType()), (T.NullType(), L), (L, T.NullType()), (T.BooleanType(), L))] == [L, L, D, S, T.TimestampType(), L, L, S]


def test_factor_folders(spark, tmp_path):
    """Names that folders can't have, files in the order merged, then parts, and months without a folder."""
    base = str(tmp_path / "factors")
    columns = "htsc_code string, time timestamp, value string"
    for name, value in (("merged.parquet", "1"), ("part_2.parquet", "3"), ("part_1.parquet", "9")):
        month_of(spark, f"{base}/factor=a_b", JAN, columns, [("x", datetime(2022, 1, 5, 8), value)], name)
    month_of(spark, f"{base}/factor=a_b", FEB, "htsc_code string, time date, value long", [("x", FEB, 7)], "merged.parquet")
    month_of(spark, f"{base}/factor=other", JAN, columns, [("x", datetime(2022, 1, 5), "5")], "merged.parquet")
    got = {(r.factor, r.time): r.value for r in store.factors(spark, base, ["a/b", "a:b ", "none"], "2022-01-01", "2022-03-01").collect()}
    assert got == {(n, d): v for n in ("a/b", "a:b ") for d, v in ((JAN, 3.0), (FEB, 7.0))}
    assert store.factors(spark, base, ["none"], "2022-01-01", "2022-03-01").count() == 0


# ---- runs


@pytest.fixture(scope="module")
def market(spark, tmp_path_factory):
    """Two years of bars, segments, and factors under their stored names."""
    import random

    base, rng, bars, long = tmp_path_factory.mktemp("market"), random.Random(6), [], []
    for code in ("A", "B", "C"):
        c = 10.0
        for k in range(0, 800, 3):
            d, c = date(2020, 12, 1) + timedelta(k), max(1.0, c * rng.choice([0.9, 0.97, 1.0, 1.04, 1.1]))
            bars.append((code, d, c, c, c, c, 1.0))
            long += [(code, d, f, str(rng.randrange(0, 3))) for f in ("MAC总", "KDJ信号", "买/入", "sell:x") if rng.random() < 0.6]
    parts = lambda df: df.withColumns({"year": F.date_format("time", "yyyy"), "month": F.date_format("time", "MM")})
    parts(spark.createDataFrame(bars, "htsc_code string, time date, open double, high double, low double, close double, volume double")).write.partitionBy("year", "month").parquet(str(base / "prices"))
    stored = parts(spark.createDataFrame(long, "htsc_code string, time date, factor string, value string")).withColumn("factor", F.regexp_replace("factor", "[/:]", "_"))
    stored.write.partitionBy("factor", "year", "month").parquet(str(base / "factors"))
    (base / "seg").mkdir()
    seg = [(c, date(y, 1, 1), date(y, 12, 31) if y < 2022 else date(9999, 12, 31), 1.0 + y % 3 / 100) for c in ("A", "B") for y in (2020, 2021, 2022)]
    spark.createDataFrame(seg, "htsc_code string, begin_date date, end_date date, xdy double").write.parquet(str(base / "seg" / store.SEGMENT_FILE))
    return base


CONFIG = {"codes": ["a", "B", "c"], "buy_rules": [{"factor": "买/入"}, {"factor": "MAC总", "threshold": 2}], "buy_operator": "or", "sell_rules": [{"factor": "sell:x", "threshold": 2}], "look_back_days": 40}


def test_stored_names(spark, market):
    """Auxiliary factors and rules are found under the names that storage gives them; signals say which factor hit; lots."""
    config = {**CONFIG, "start_date": "2021-01-01", "end_date": "2022-01-01", "lot_size": 100}
    found = api.run_configured(spark, config, str(market / "prices"), str(market / "factors"), segment_base=str(market / "seg"))
    frame = found["_frame"]
    sums = frame.agg(*(F.sum(c) for c in ("mac_total", "kdj_signal", "obv_bullish", "buy_factor_0", "sell_factor_0"))).first()
    assert sums[0] > 0 and sums[1] > 0 and sums[2] == 0 and sums[3] > 0 and sums[4] > 0
    orders = found["orders"].collect()
    assert {r.signal for r in orders if r.side == "SELL"} == {"sell:x"} and {r.signal for r in orders if r.side == "BUY"} <= {"买/入", "MAC总", "买/入+MAC总"}
    assert orders and all(r.executed_size % 100 == 0 and r.date >= date(2021, 1, 1) for r in orders)
    row = found["summary"].first()
    assert row.held and all(h.weight.endswith("%") and h["return"] and h.contribution and h.position_size and h.close for h in row.held)
    weights = [float(h.weight[:-1]) for h in row.held]
    assert weights == sorted(weights, reverse=True)
    api.discard(found)


@pytest.mark.parametrize("model", ["signal_rules_masked", "configurable_exits"])
def test_many_runs_equal_single_ones(spark, market, model, monkeypatch):
    """The years of a batch in one plan give what each gives alone."""
    monkeypatch.setattr(api, "LOOK_AHEAD", api.YEARLY_LOOK_AHEAD)
    at = [str(market / "prices"), str(market / "factors")]
    spans = [("y2021", "2021-01-01", "2022-01-01"), ("half", "2021-07-01", "2022-03-01")]
    config = {**CONFIG, "adopt_model": model}
    many = api.run_many(spark, config, spans, *at, segment_base=str(market / "seg"))
    whole = {name: {} for name in ("orders", "trades", "daily", "positions", "curves", "summary")}
    rounded = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    for name in whole:
        for r in many[name].collect():
            d = r.asDict(recursive=True)
            run = d.pop("run", None) or d.get("name")
            whole[name].setdefault(run, []).append(str(rounded(v for k, v in sorted(d.items()) if k not in ("run_tag", "name", "title"))))
    for run, a, b in spans:
        one = api.run_configured(spark, {**config, "start_date": a, "end_date": b, "run_name": run}, *at, segment_base=str(market / "seg"))
        for name in whole:
            mine = [r.asDict(recursive=True) for r in one[name].collect()]
            assert sorted(whole[name].get(run, [])) == sorted(str(rounded(v for k, v in sorted(d.items()) if k not in ("run_tag", "name", "title"))) for d in mine), (run, name)
    for bad in ([], [("x", "2021-01-01", "2021-01-01")], [("x", "2021-01-01", "2022-01-01")] * 2):
        with pytest.raises(ValueError):
            api.run_many(spark, config, bad, *at)


def test_command_line(spark, market, tmp_path, monkeypatch):
    base = ["--prices", str(market / "prices"), "--factors", str(market / "factors"), "--segments", str(market / "seg"), "--buy", "买/入", "--sell", "sell:x"]
    (tmp_path / "codes.csv").write_text("证券代码\na\nB\n")
    api.main([*base, "--codes-file", str(tmp_path / "codes.csv"), "--years", "2021", "2022", "--out", str(tmp_path / "years")])
    summaries = spark.read.json(str(tmp_path / "years/summary")).collect()
    assert {r.run_tag for r in summaries} == {"2021", "2022"} and all(r.n_trades > 0 for r in summaries)
    assert {r.name for r in snapshots.read(spark, str(tmp_path / "years/curves")).collect()} <= {"2021", "2022", 2021, 2022}
    api.main([*base, "--codes", "A", "--start", "2021-02-01", "--end", "2021-06-01", "--model", "configurable_exits", "--out", str(tmp_path / "one")])
    assert spark.read.json(str(tmp_path / "one/summary")).first().start_date == "2021-02-01"
    for bad in (["--codes", "A", "--start", "2021-02-01"], ["--codes", "A", "--start", "2021-01-01", "--end", "2021-02-01", "--years", "2021"], ["--years", "2021"]):
        with pytest.raises(SystemExit):
            api.main([*base, *bad, "--out", str(tmp_path / "bad")])


def test_open_ended_segments(spark):
    """Fifty segments without an end cost no more rows than there are bars."""
    days = [date(2020, 1, 1) + timedelta(k) for k in range(700)]
    bars = spark.createDataFrame([("A", d, 1.0, 1.0, 1.0, 1.0) for d in days], "htsc_code string, time date, open double, high double, low double, close double")
    seg = spark.createDataFrame([(c, date(1990, 1, 1), date(9999, 12, 31), 2.0) for c in ("A", *(f"X{k}" for k in range(49)))], "htsc_code string, begin_date date, end_date date, xdy double")
    assert frames.binned(seg, bars).count() == 23
    many = spark.createDataFrame([("A", date(1990, 1, 1) + timedelta(k), date(9999, 12, 31), 1.0) for k in range(29)], seg.schema)
    assert frames.binned(many, bars).count() <= len(days)
    got = frames.adjusted(bars, seg, "backward").collect()
    assert len(got) == 700 and all(r.close == (2.0 if r.time.weekday() < 5 else 1.0) for r in got)
