"""Bars against a plain loop, their edge cases and properties, and the streaming forms."""

from __future__ import annotations

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallybar.functions.interval import parse_interval
from tallybar.operators import bars
from tallybar.sources import readers, writers
from tallybar.streaming import bars as streaming

SCHEMA = "k string, seq long, time long, price double, qty double, quote double"


def rows_of(seed=1, n=400, keys=("a", "b"), late=True):
    rng, out, clock = random.Random(seed), [], 0
    for i in range(n):
        clock += rng.randrange(0, 90_000)
        price, qty = round(rng.uniform(1, 9), 2), round(rng.uniform(0, 3), 2)
        out.append((rng.choice(keys), i, max(0, clock - (rng.randrange(0, 400_000) if late else 0)), price, qty, price * qty))
    return out


def bar_of(group):
    return (group[0][2], group[0][3], max(r[3] for r in group), min(r[3] for r in group), group[-1][3], sum(r[4] for r in group), sum(r[5] for r in group), len(group))


def by_loop(rows, closes):
    out = []
    for key in sorted({r[0] for r in rows}):
        state, group = None, []
        for r in (r for r in rows if r[0] == key):
            cut, before, state = closes(state, r)
            if before and group:
                out.append((key, *bar_of(group)))
                group = []
            group.append(r)
            if cut:
                out.append((key, *bar_of(group)))
                group = []
        if group:
            out.append((key, *bar_of(group)))
    return out


def by_time(length):
    def closes(state, r):
        own = r[2] // length
        return False, state is not None and own > state, own if state is None else max(own, state)

    return closes


def by_sum(column, threshold):
    def closes(state, r):
        total = (state or 0.0) + r[column]
        return total >= threshold, False, 0.0 if total >= threshold else total

    return closes


def same(got, want):
    got, want = sorted(map(tuple, got)), sorted(want)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and a[8] == b[8]
        assert a[2:8] == pytest.approx(b[2:8])


@pytest.mark.parametrize("chunk", [1_000_000, 37])
def test_time_bars(spark, chunk):
    rows = rows_of()
    got = bars.time_bars(spark.createDataFrame(rows, SCHEMA).repartition(5), "5m", ("k",), chunk).collect()
    same(got, by_loop(rows, by_time(300_000)))


@pytest.mark.parametrize("chunk", [1_000_000, 7])
def test_time_bars_of_tied_trades(spark, chunk):
    rng = random.Random(8)
    rows = sorted(((k, seq // 6, time, *rest) for k, seq, time, *rest in rows_of(8)), key=lambda r: r[1:])
    want = by_loop(rows, by_time(300_000))
    for parts in (1, 3, 5):
        rng.shuffle(rows)
        same(bars.time_bars(spark.createDataFrame(rows, SCHEMA).repartition(parts), "5m", ("k",), chunk).collect(), want)


def test_threshold_bars(spark):
    rows = rows_of(2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    same(bars.volume_bars(df, 7.5, ("k",)).collect(), by_loop(rows, by_sum(4, 7.5)))
    same(bars.dollar_bars(df, 40.0, ("k",)).collect(), by_loop(rows, by_sum(5, 40.0)))
    one = [("a", *r[1:]) for r in rows]
    got = [("a", *r) for r in bars.volume_bars(spark.createDataFrame(one, SCHEMA), 7.5).collect()]
    same(got, by_loop(one, by_sum(4, 7.5)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(0, 5), min_size=1, max_size=300), st.floats(0.1, 20))
def test_fold_keeps_all_trades(quantities, threshold):
    import numpy as np

    q = np.array(quantities)
    fold = bars.Fold(threshold)
    closed = [b for part in np.array_split(np.arange(len(q)), 3) if len(part) for b in fold.feed(part, q[part] + 1, q[part], q[part], q[part])]
    last = [fold.close()] if fold.open else []
    assert sum(b[7] for b in closed + last) == len(q)
    assert sum(b[5] for b in closed + last) == pytest.approx(q.sum())
    assert all(b[5] >= threshold for b in closed) and all(b[3] <= b[1] <= b[2] and b[3] <= b[4] <= b[2] for b in closed + last)


def test_edges(spark):
    df = lambda rows: spark.createDataFrame([("a", i, *r, r[1] * r[2]) for i, r in enumerate(rows)], SCHEMA)
    on_the_end = bars.time_bars(df([(0, 1.0, 1.0), (299_999, 2.0, 1.0), (300_000, 3.0, 1.0), (3_000_000, 4.0, 1.0)]), "5m").collect()
    assert sorted(r["trade_count"] for r in on_the_end) == [1, 1, 2]
    assert [r["volume"] for r in bars.volume_bars(df([(0, 1.0, 50.0)]), 10.0).collect()] == [50.0]
    assert [r["volume"] for r in bars.volume_bars(df([(0, 1.0, 4.0), (1, 1.0, 6.0)]), 10.0).collect()] == [10.0]
    empty = df([]) if False else spark.createDataFrame([], SCHEMA)
    assert bars.time_bars(empty, "1h").count() == 0 and bars.volume_bars(empty, 1.0, ("k",)).count() == 0
    for bad in (0, -1, math.nan):
        with pytest.raises(ValueError, match="above zero"):
            bars.volume_bars(empty, bad)


def test_intervals():
    assert [parse_interval(x) for x in ("5m", "1h", "1d", " 2min ", "3hour", "1day")] == [300_000, 3_600_000, 86_400_000, 120_000, 10_800_000, 86_400_000]
    for bad in ("", "abc", "5x", "5", "5 m", "0m"):
        with pytest.raises(ValueError):
            parse_interval(bad)


def test_calibration(spark):
    day = 86_400_000
    spans = {"1m": 100 * 30_000, "5m": 100 * 5 * 60_000, "1h": 100 * 3_700_000, "1d": int(100 * 1.9 * day)}
    rows = [(k, i, t, 2.0, 3.0, 6.0) for k, span in spans.items() for i, t in enumerate((0, span))]
    got = {r["k"]: r for r in bars.calculate_thresholds(spark.createDataFrame(rows, SCHEMA), 100, ("k",)).collect()}
    assert {k: r["interval"] for k, r in got.items()} == {k: k for k in spans}
    assert got["1h"]["volume_threshold"] == pytest.approx(0.06) and got["1h"]["dollar_threshold"] == pytest.approx(0.12)
    with pytest.raises(Exception, match="span no time"):
        bars.calculate_thresholds(spark.createDataFrame(rows[:1], SCHEMA), 10).collect()
    with pytest.raises(ValueError):
        bars.calculate_thresholds(spark.createDataFrame(rows, SCHEMA), 0)


def test_files(spark, tmp_path):
    rows = [(i, 1_704_067_200_000 + 1000 * i, 42000 + 100 * math.sin(0.1 * i), 0.01 + 0.05 * abs(math.sin(0.03 * i)), True) for i in range(3600)]
    path = str(tmp_path / "trades")
    spark.createDataFrame(rows, "id long, DateTime long, Price double, Qty double, isBest boolean").coalesce(1).write.parquet(path)
    trades = readers.read_trades(spark, path)
    out = str(tmp_path / "bars")
    assert writers.write_bars(bars.time_bars(trades, "5m"), out, single_file=True) == 12
    assert len(spark.read.parquet(out).columns) == 8
    with pytest.raises(ValueError, match="own input"):
        writers.write_bars(spark.read.parquet(out), out)
    info = readers.parquet_info(spark, path).first()
    assert info["num_rows"] == 3600 and info["num_row_groups"] == 1 and info["column_names"].startswith("id,DateTime")
    with pytest.raises(TypeError):
        readers.as_trades(spark.createDataFrame([(1, 1, 1, 1)], "DateTime long, Price int, Qty int, s long"), "s")
    with pytest.raises(ValueError, match="missing"):
        readers.as_trades(spark.createDataFrame([(1, 1)], "DateTime long, s long"), "s")


def test_series_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,x,y,z\na,1.5,,7\nb, 2.5,3,oops\nc,1e3,4\n")
    got = readers.read_series(spark, str(tmp_path / "a.csv")).orderBy("t").collect()
    assert [(r["x"], r["y"], r["z"]) for r in got] == [(1.5, None, 7.0), (None, 3.0, None), (1000.0, 4.0, None)]
    (tmp_path / "a.tsv").write_text("x\ty\n1\t2\n")
    assert readers.read_series(spark, str(tmp_path / "a.tsv")).columns == ["t", "x", "y"]
    spark.createDataFrame([(1, 2.0, 3, "s")], "a long, b double, c int, d string").coalesce(1).write.parquet(str(tmp_path / "p.parquet"))
    assert readers.read_series(spark, str(tmp_path / "p.parquet"), exclude=("a",)).columns == ["t", "b"]
    with pytest.raises(ValueError):
        readers.read_series(spark, "x.json")


@pytest.mark.parametrize("kind", ["volume", "dollar", "time"])
def test_streams_give_the_closed_bars(spark, tmp_path, kind):
    rows = rows_of(5, 240)
    for i in range(4):
        spark.createDataFrame(rows[60 * i : 60 * i + 60], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(tmp_path / "in"))
    make = {"volume": lambda s: streaming.volume_bars(s, 7.5, "k"), "dollar": lambda s: streaming.dollar_bars(s, 40.0, "k"), "time": lambda s: streaming.time_bars(s, "5m", "k")}[kind]
    started = make(stream).writeStream.format("memory").queryName(f"bars_{kind}").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    started.awaitTermination(120)
    want = by_loop(rows, {"volume": by_sum(4, 7.5), "dollar": by_sum(5, 40.0), "time": by_time(300_000)}[kind])
    got = sorted(map(tuple, spark.table(f"bars_{kind}").collect()))
    still_open = {k: [b for b in want if b[0] == k][-1] for k in ("a", "b")}
    closed = [b for b in want if b != still_open[b[0]]]
    assert len(closed) <= len(got) <= len(want)
    same(got, [*closed, *[b for b in still_open.values() if any(g[:2] == b[:2] for g in got)]])


def test_nan_prices_and_null_times(spark, tmp_path):
    nan = math.nan
    trades = spark.createDataFrame([("a", i, 1000 * i, p, 1.0, p) for i, p in enumerate([nan, 2.0, nan, 3.0, nan])] + [("b", 0, 0, nan, 1.0, nan)], SCHEMA)
    for made in (bars.time_bars(trades, "1h", ("k",)), bars.volume_bars(trades, 100.0, ("k",))):
        got = {r["k"]: r for r in made.collect()}
        assert (got["a"]["high"], got["a"]["low"], got["a"]["trade_count"]) == (3.0, 2.0, 5) and (got["b"]["high"], got["b"]["low"]) == (-math.inf, math.inf)
    late = spark.createDataFrame([(1, None, 1.0, 1.0)], "s long, DateTime long, Price double, Qty double")
    with pytest.raises(Exception, match="null in DateTime"):
        readers.as_trades(late, "s").collect()


def test_nanosecond_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = str(tmp_path / "ns.parquet")
    pq.write_table(pa.table({"DateTime": pa.array([1_704_067_200_123_456_789, -1_999_999], pa.timestamp("ns")), "Price": [1.0, 2.0], "Qty": [1.0, 1.0]}), path)
    spark.conf.set(readers.NANOS, "true")
    try:
        assert [r["time"] for r in readers.read_trades(spark, path).orderBy("seq").collect()] == [1_704_067_200_123, -1]
    finally:
        spark.conf.unset(readers.NANOS)


def test_names_with_commas(spark, tmp_path):
    from tallybar import api

    spark.createDataFrame([(1, 2)], "`a,b` long, c long").coalesce(1).write.parquet(str(tmp_path / "x.parquet"))
    assert api.parquet_info(spark, str(tmp_path / "x.parquet")) == (1, 1, ["a,b", "c"])
