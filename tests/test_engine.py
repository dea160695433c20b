"""Golden values, properties and plans of the engine's own operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colstrata import registry
from colstrata.functions import scalar as S
from colstrata.operators import aggregates as A
from colstrata.operators import encoding as E
from colstrata.operators import joins as J
from colstrata.operators import market as M
from colstrata.operators import sorting as ST
from colstrata.operators import windows as W
from colstrata.operators.frame import Frame
from colstrata.operators.ordered import row_index, running_sum
from colstrata.plans import explain
from colstrata.plans.bounds import Bounds
from colstrata.plans.sql import NotSupported, execute
from colstrata.sources import LargeData, from_list, load_csv, raw_f64
from colstrata.streaming.streams import Feed, stream_filter_sum


def one(df):
    return df.first()[0]


def test_golden_filter_sum(spark):
    f = Frame.from_list(spark, [float(i) for i in range(1, 9)])
    assert f.filter_gt(4.0).sum().value_of() == 26.0
    assert f.run().first()[0] == 36.0
    assert [r.x for r in f.topk(3).run().collect()] == [8.0, 7.0, 6.0]
    assert f.filter_gt(4.0).avg().value_of() == 6.5
    assert f.filter_gt(4.0).count().value_of() == 4
    assert [r.x for r in f.bottomk(2).run().collect()] == [1.0, 2.0]
    assert f.filter_lt(1.0).sum().value_of() == 0.0
    assert f.filter_lt(1.0).min().value_of() is None


def test_golden_rows_and_order(spark):
    f = Frame.from_list(spark, [1.0, 3.0, 5.0, 7.0, 2.0, 4.0, 6.0, 8.0])
    assert sorted(r.row_idx for r in f.filter_gt(4.0).frame().collect()) == [2, 3, 6, 7]
    s = from_list(spark, [3.0, 1.0, 4.0, 1.0, 5.0])
    assert [r.row_idx for r in ST.sort_index(s, "x", "row_idx").orderBy("pos").collect()] == [1, 3, 0, 2, 4]
    assert [r.row_idx for r in Frame(s).sort().run().collect()] == [1, 3, 0, 2, 4]


def test_golden_groups_and_joins(spark):
    g = spark.createDataFrame([(0, 10), (1, 20), (0, 30), (1, 40), (0, 50)], "k int, v long")
    assert {(r.k, r["sum"], r["count"]) for r in A.grouped(g, ["k"], "v").collect()} == {(0, 90, 3), (1, 60, 2)}
    build = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 3), (4, 4)], "k int, row long")
    probe = spark.createDataFrame([(2,), (4,), (6,)], "k int")
    assert {(r.k, r.row) for r in J.first_match(probe, build, "k", "row").collect()} == {(2, 1), (4, 4)}
    assert {(r.k, r.row_id) for r in J.lookup(probe, build, "k", "row").collect()} == {(2, 1), (4, 3), (6, -1)}
    assert one(J.count_pairs(probe, build, "k")) == 3


def test_nan_passes_no_filter(spark):
    f = Frame.from_list(spark, [1.0, float("nan"), 9.0, None])
    assert f.filter_gt(5.0).count().value_of() == 1
    assert f.filter_le(5.0).count().value_of() == 1
    assert f.is_null().frame().count() == 1


@given(st.lists(st.tuples(st.sampled_from(["gt", "ge", "lt", "le", "ne"]), st.integers(-5, 5)), max_size=6), st.integers(-7, 7))
def test_bounds_are_the_conjunction(steps, x):
    b = Bounds()
    for op, t in steps:
        b = b.without(t) if op == "ne" else b.above(t, op == "gt") if op[0] == "g" else b.below(t, op == "lt")
    want = all({"gt": x > t, "ge": x >= t, "lt": x < t, "le": x <= t, "ne": x != t}[op] for op, t in steps)
    low = b.low is None or (x > b.low if b.low_strict else x >= b.low)
    high = b.high is None or (x < b.high if b.high_strict else x <= b.high)
    assert (low and high and x not in b.excluded and not b.empty()) == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=3, max_size=60), st.integers(2, 6))
def test_rolling_blocks_equal_brute_force(spark, values, window):
    df = from_list(spark, values)
    got = {r.row_idx: r["sum"] for r in W.rolling(df, "x", "row_idx", window, "sum", block=7).collect()}
    want = {i: sum(values[i - window + 1 : i + 1]) for i in range(window - 1, len(values))}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_row_index_over_many_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("a"), F.col("id").cast("string").alias("b"))
    got = [r.row_idx for r in row_index(df, ["a", "b"], rows=300).orderBy("a", "b").collect()]
    assert got == list(range(5000))
    ties = spark.range(1000).select((F.col("id") % 2).alias("a"), "id")
    assert [r.i for r in row_index(ties, ["a", "id"], "i", rows=100).orderBy("a", "id").collect()] == list(range(1000))
    assert one(running_sum(df.limit(0), F.lit(1), ["a"], "s").agg(F.count("*"))) == 0


def test_order_over_many_ranges_with_nulls_and_directions(spark):
    rng = np.random.default_rng(4)
    rows = [(i, None if i % 17 == 0 else float("nan") if i % 23 == 0 else float(rng.integers(0, 50)), None if i % 13 == 0 else f"s{rng.integers(0, 40)}") for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, x double, s string").repartition(6)
    last = lambda v, down: (v is None, () if v is None else (-1 if down else 1) * (1e9 if isinstance(v, float) and np.isnan(v) else v))
    for down in (False, True):
        want = sorted(rows, key=lambda r: (last(r[1], down), r[0]))
        got = ST.row_index(df.select("x", "id"), [ST.Key("x", down, True), ST.Key("id")], "pos", rows=60).orderBy("pos").collect()
        assert [r.id for r in got] == [r[0] for r in want] and [r.pos for r in got] == list(range(4000))
        named = sorted((r for r in rows if r[2]), key=lambda r: r[0])
        named = sorted(named, key=lambda r: r[2], reverse=down) + sorted((r for r in rows if not r[2]), key=lambda r: r[0])
        got = ST.row_index(df.select("s", "id"), [ST.Key("s", down, True), ST.Key("id")], "pos", rows=60).orderBy("pos").collect()
        assert [r.id for r in got] == [r[0] for r in named]
        assert [r.id for r in ST.sort_index(df, "s", "id", not down).orderBy("pos").collect()] == [r[0] for r in named]
    assert [r.id for r in ST.sort_index(spark.createDataFrame([(0, -(2**63)), (1, 5)], "id long, v long"), "v", "id", False).orderBy("pos").collect()] == [1, 0]


def test_runs_rolling_and_ema_over_many_ranges(spark):
    rng = np.random.default_rng(5)
    kinds = [None if k == 3 else f"k{k}" for k in rng.integers(0, 4, 3000).tolist()]
    df = spark.createDataFrame([(i, k, float(i % 7)) for i, k in enumerate(kinds)], "id long, k string, x double").repartition(5)
    want = []
    for i, k in enumerate(kinds):
        if want and want[-1][0] == k:
            want[-1][1] += 1
        else:
            want.append([k, 1, i])
    got = A.rle(df, "k", "id", rows=50).orderBy("run").collect()
    assert [[r.k, r.length, r["first"]] for r in got] == want and [r.run for r in got] == list(range(len(want)))
    got = W.framed(df, "id", -4, 2, {"s": lambda w: F.sum("x").over(w)}, block=40, rows=50).orderBy("id").collect()
    assert [r.s for r in got] == [sum(float(j % 7) for j in range(max(0, i - 4), min(3000, i + 3))) for i in range(3000)]
    order = [f.name for f in ST.row_index(df, ["id"], "n", rows=60).schema]
    assert order == ["id", "k", "x", "n"]


def test_order_searches_cuts_by_halves(spark):
    """No row is compared with all cuts: the cuts are one broadcast row, and the search has some ten steps."""
    df = spark.range(100_000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("a"), "id")
    plan = row_index(df, ["a", "id"], rows=100)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "aggregate(" in plan and "filter(__cut" not in plan
    import time

    took = []
    for rows in (1 << 20, 100, 1 << 20, 100):
        began = time.perf_counter()
        assert row_index(df, ["a", "id"], rows=rows).agg(F.sum("row_idx")).first()[0] == 100_000 * 99_999 // 2
        took.append(time.perf_counter() - began)
    assert took[3] < 3 * took[2] + 3  # some jobs more; the search itself hardly shows


def test_working_columns_leave_the_users_alone(spark):
    names = ["_v", "_p", "_in", "_o", "_n", "_i", "_block", "_own", "__part", "__at", "__block", "__carry", "__value", "_t", "_side", "_row", "_cell", "_home", "__hit"]
    df = spark.createDataFrame([(i, float(i), i % 3, *["x"] * len(names)) for i in range(60)], "id long, x double, k int, " + ", ".join(f"`{n}` string" for n in names))
    for out in (
        row_index(df, ["id"], rows=7), W.rolling(df, "x", "id", 3, "sum", block=9), W.value_range(df, "x", 2.0), E.delta_encode(df, "x", "id"), J.asof_join(df, df.select("k", F.col("id").alias("z"), F.col("x").alias("y")), "k", "id", "z", "y", "found"),
        J.contains(df, df.select("k"), "k"), E.frame_of_reference(df, "x"),
    ):
        assert all(out.first()[n] == "x" for n in names) and set(out.columns) > set(df.columns)


def test_value_range_keeps_nulls_and_takes_radius_0(spark):
    df = spark.createDataFrame([(0, 1.0, 1), (1, None, 1), (2, 1.5, 1), (3, 900.0, 1), (4, 1.0, 1)], "id int, x double, k int")
    for radius, want in ((0.5, {0: (3, 3.5), 1: (0, None), 2: (3, 3.5), 3: (1, 900.0), 4: (3, 3.5)}), (0.0, {0: (2, 2.0), 1: (0, None), 2: (1, 1.5), 3: (1, 900.0), 4: (2, 2.0)})):
        for keys in ((), ("k",)):
            assert {r.id: (r.range_count, r.range_sum) for r in W.value_range(df, "x", radius, keys).collect()} == want


def test_merge_of_states_far_from_0(spark):
    df = spark.createDataFrame([(i % 7, 1e9 + i % 3, None if i % 2 else "k") for i in range(300)], "part int, x double, k string")
    merged = A.merge(df.groupBy("part").agg(*A.state("x"))).first()
    assert merged["count"] == 300 and merged.variance == pytest.approx(np.var([i % 3 for i in range(300)], ddof=1), rel=1e-6)
    by = {r.k: r.variance for r in A.merge(df.groupBy("k", "part").agg(*A.state("x")), ["k"]).collect()}
    assert by == pytest.approx({k: np.var([i % 3 for i in range(300) if i % 2 == (k is None)], ddof=1) for k in (None, "k")}, rel=1e-6)
    assert A.merge(df.limit(0).groupBy("part").agg(*A.state("x")), ["part"]).collect() == []


@pytest.mark.parametrize("op", ["lt", "le", "gt", "ge", "ne", "eq"])
def test_theta_join_of_two_large_sides(spark, op):
    import operator

    rng = np.random.default_rng(6)
    a, b = ([None if v == 0 else int(v) for v in rng.integers(0, 25, n)] for n in (60, 90))
    left, right = (spark.createDataFrame([(i, v) for i, v in enumerate(x)], f"{n} int, {m} int").repartition(3) for x, n, m in ((a, "i", "x"), (b, "j", "y")))
    want = {(i, j) for i, v in enumerate(a) for j, w in enumerate(b) if v is not None and w is not None and getattr(operator, op)(v, w)}
    for limit in (1000, 70, 10):
        got = J.theta_join(left, right, "x", op, "y", limit_rows=limit, rows=8).select("i", "j").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want, limit


@pytest.mark.parametrize("op", ["lt", "le", "gt", "ge", "ne", "eq"])
def test_theta_groups(spark, op):
    import operator

    rng = np.random.default_rng(7)
    odd = lambda v: [None, math.nan, -0.0, 0.0, float(v)][min(int(v), 4)]
    a, b = ([(int(k), odd(v)) for k, v in zip(rng.integers(0, 9, n), rng.integers(0, 25, n))] for n in (60, 90))
    b = [(None if j % 5 == 0 else j, w) for j, w in b]
    rank = lambda v: (1, 0.0) if math.isnan(v) else (0, v)  # NaN is the greatest and equals itself
    want: dict = {}
    for k, v in a:
        for j, w in b:
            if v is not None and w is not None and getattr(operator, op)(rank(v), rank(w)):
                want.setdefault(k, []).append(j)
    want = {(k, len(js), min((j for j in js if j is not None), default=None), max((j for j in js if j is not None), default=None)) for k, js in want.items()}
    left, right = (spark.createDataFrame(x, f"{k} int, `{v}` double").repartition(3) for x, k, v in ((a, "i", "x.1"), (b, "j", "y.1")))
    for rows in (4, 1000):
        got = J.theta_groups(left, right, "i", "x.1", op, "y.1", "j", rows).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want, rows


def most_rows(spark):
    """The most rows that an operator of the last execution put out."""
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last()
    found = store.executionMetrics(last.executionId())
    ids = [m.accumulatorId() for m in explain._each(last.metrics()) if m.name() == "number of output rows"]
    return max(int(found.apply(i).replace(",", "")) for i in ids if found.contains(i))


@pytest.mark.parametrize("op,share", [("lt", 499.5), ("le", 500.5), ("gt", 499.5), ("ge", 500.5), ("ne", 999)])
def test_theta_ranges_query_makes_no_pairs(spark, tmp_path, op, share):
    n = 2000  # two of each of 1,000 values on either side: at least two million pairs less those of equal values
    for table, key, value in (("part", "p_partkey", "p_retailprice"), ("supplier", "s_suppkey", "s_acctbal")):
        spark.range(n).selectExpr(f"id AS {key}", f"CAST(id % 1000 AS DOUBLE) AS {value}").write.parquet(f"{tmp_path}/{table}.parquet")
    registry.QUERIES[f"join_theta_ranges_{op}"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    widest = most_rows(spark)
    assert sum(r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()) == n * 2 * share
    assert widest <= 2 * n


def test_merge_of_parts_equals_whole(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    parts = li.groupBy(F.pmod("l_partkey", F.lit(7))).agg(*A.state("l_quantity"))
    got, want = A.merge(parts).first(), li.agg(F.count("*"), F.avg("l_quantity"), F.var_samp("l_quantity")).first()
    assert got["count"] == want[0] and abs(got["mean"] - want[1]) < 1e-9 and abs(got["variance"] - want[2]) < 1e-6


def test_encodings_round_trip(spark):
    df = from_list(spark, [1.0, 1.0, 1.0, 2.0, 2.0, 3.0])
    runs = E.rle(df, "x", "row_idx")
    assert [(r.x, r.length) for r in runs.orderBy("run").collect()] == [(1.0, 3), (2.0, 2), (3.0, 1)]
    assert [r.x for r in E.rle_decode(runs, "x").orderBy("run", "offset").collect()] == [1.0, 1.0, 1.0, 2.0, 2.0, 3.0]
    assert E.dictionary(from_list(spark, [1.0, 2.0, 1.0, 2.0, 3.0]), "x").count() == 3
    d = E.delta_decode(E.delta_encode(df, "x", "row_idx"), "row_idx")
    assert [r.value for r in d.orderBy("row_idx").collect()] == [1.0, 1.0, 1.0, 2.0, 2.0, 3.0]


@pytest.mark.parametrize("x", [0, 1, 6, -1, 2**62, -(2**63), 12345678901])
def test_bit_functions(spark, x):
    u = x & (2**64 - 1)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    r = spark.createDataFrame([(x,)], "x long").select(S.trailing_zeros("x"), S.leading_zeros("x"), S.rotate_left("x", 13), S.bit_reverse("x"), S.byte_swap("x")).first()
    assert r[0] == (64 if not u else (u & -u).bit_length() - 1)
    assert r[1] == 64 - u.bit_length()
    assert r[2] == signed(((u << 13) | (u >> 51)) & (2**64 - 1))
    assert r[3] == signed(int(f"{u:064b}"[::-1], 2))
    assert r[4] == signed(int.from_bytes(u.to_bytes(8, "big"), "little"))


def test_sources(spark, tmp_path):
    a = np.arange(1000, dtype="<f8")
    a.tofile(tmp_path / "f64.bin")
    df = raw_f64(spark, str(tmp_path / "f64.bin"))
    assert [tuple(r) for r in df.where("row_idx IN (0, 7, 999)").orderBy("row_idx").collect()] == [(0, 0.0), (7, 7.0), (999, 999.0)]
    big = LargeData(df)
    assert big.sum() == a.sum() and big.sum(500) == a[a > 500].sum() and big.count_above(998) == 1 and len(big) == 1000
    assert one(big.chunked_sum(100).agg(F.count("*"))) == 10
    (tmp_path / "x.csv").write_text("a,b\n1.5,x\nbad,2\n2.5,3\n")
    assert sorted(r.x for r in load_csv(spark, str(tmp_path / "x.csv")).collect()) == [1.5, 2.5]
    assert [r.x for r in load_csv(spark, str(tmp_path / "x.csv"), 1).orderBy("x").collect()] == [2.0, 3.0]
    assert one(execute(spark, "SELECT sum(x) FROM t", {"t": str(tmp_path / "x.csv")})) == 4.0


def test_sql_rejects_writes(spark):
    for text in ("INSERT INTO t VALUES (1)", "DELETE FROM t", "DROP TABLE t", " update t set a = 1"):
        with pytest.raises(NotSupported):
            execute(spark, text)
    assert one(execute(spark, "-- note\nSELECT 1 + 1")) == 2


def test_stream_dedup_keeps_rows_out_of_the_driver_and_drops_none(spark, tmp_path):
    days = spark.range(800).selectExpr("id AS event_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(CAST(id AS INT)) AS ts", "id % 7 AS user_id", "concat('t', id % 3) AS event_type", "CAST(id AS DOUBLE) AS value")
    days.repartition(5).write.parquet(f"{tmp_path}/events.parquet")  # two years, the state is kept for 30 days
    df = registry.QUERIES["stream_dedup"](spark, str(tmp_path))
    assert df.inputFiles()  # rows of a table in memory come from no file
    assert sorted(map(tuple, df.collect())) == [("t0", 267), ("t1", 267), ("t2", 266)]


def test_stream_dedup_of_no_rows(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    assert registry.QUERIES["stream_dedup"](spark, str(tmp_path)).collect() == []


def test_stream_equals_batch(spark, tmp_path):
    x = np.random.default_rng(3).uniform(0, 1000, 3000)
    got = stream_filter_sum(spark, np.array_split(x, 5), 500.0, f"file://{tmp_path}/a")
    assert abs(got - x[x > 500].sum()) < 1e-6
    feed = Feed(spark, f"file://{tmp_path}/b", 0.0)
    feed.feed([1.0, 2.0])
    assert feed.flush() == (3.0, 2)
    feed.feed([4.0])
    assert feed.flush() == (7.0, 3)


def test_market_object(spark):
    m = M.MarketData.from_arrays(spark, [1.0, 2.0, 4.0, 2.0], [1, 1, 1, 1])
    assert len(m) == 4 and m.vwap().first().vwap == 2.25
    assert m.max_drawdown().first().max_drawdown == -0.5
    assert [r.ema for r in m.ema(3).orderBy("ts").collect()] == [1.0, 1.5, 2.75, 2.375]
    assert [round(r.rsi, 6) for r in m.rsi(2).orderBy("ts").collect()] == [100.0, 50.0]


def test_plans(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    q = Frame(li, "l_quantity").filter_gt(10.0).filter_gt(25.0).frame().agg(F.sum("l_extendedprice"))
    assert "GreaterThan(l_quantity,25.0)" in explain.pushed_filters(q) and "GreaterThan(l_quantity,10.0)" not in explain.pushed_filters(q)
    assert explain.read_columns(q) == ["l_extendedprice", "l_quantity"]
    assert "TakeOrderedAndProject" in explain.plan(ST.topk(li, "l_extendedprice", "l_orderkey", 5))
    assert not explain.has_python(A.grouped(li, ["l_returnflag"], "l_quantity")) and explain.exchanges(A.grouped(li, ["l_returnflag"], "l_quantity")) == 1
    assert explain.metrics(li.limit(5)).first()["rows"] == 5


def test_one_series_of_prices_needs_no_symbol_and_no_single_task(spark):
    rng = np.random.default_rng(8)
    price = 99 + np.abs(np.cumsum(rng.normal(0, 1, 9000)))
    df = spark.createDataFrame([(i, float(p), 1.0) for i, p in enumerate(price)], "ts long, price double, volume double").repartition(4)
    m = M.MarketData(df)
    want, s = [], None
    for p in price.tolist():
        s = p if s is None else p * 2 / 21 + s * (1 - 2 / 21)
        want.append(s)
    for rows in (1 << 18, 500):
        got = M.ema(df, 20, rows=rows).orderBy("ts").collect()
        assert np.allclose([r.ema for r in got], want, rtol=1e-12)
    two = df.withColumn("symbol", F.lit("a")).unionByName(df.where("ts < 50").withColumn("symbol", F.lit(None).cast("string")))
    got = {(r.symbol, r.ts): r.ema for r in M.ema(two, 20, rows=700).collect()}
    assert len(got) == 9050 and all(abs(got["a", i] - want[i]) < 1e-9 for i in range(9000)) and all(abs(got[None, i] - want[i]) < 1e-9 for i in range(50))
    top = np.maximum.accumulate(price)
    assert M.max_drawdown(df, rows=400).first()[0] == pytest.approx(((price - top) / top).min())
    assert one(m.sum()) == pytest.approx(price.sum()) and one(m.mean()) == pytest.approx(price.mean())
    assert one(m.count_above(100.0)) == (price > 100).sum() and one(m.sum_above(100.0)) == pytest.approx(price[price > 100].sum())
    assert m.rolling_mean(10).count() == 8991 and m.log_returns().count() == 8999 and m.var(50, 0.95).count() == 8950
    assert m.stats().count() == 1 and "symbol" not in m.stats().columns
    assert len(m.time_ohlc(3600).columns) == 6 and m.resample_ohlc(100).count() == 90


def test_hot_keys_are_cut_in_ranges(spark):
    """Keyed frames, runs and as-of joins where one key has most rows and spans many ranges."""
    rng = np.random.default_rng(9)
    rows = [(i, None if i % 50 == 7 else "hot" if i % 3 else f"k{i % 5}", float(rng.integers(0, 3))) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, k string, x double").repartition(5)
    by = {}
    for i, k, x in rows:
        by.setdefault(k, []).append((i, x))
    for full in (False, True):
        want = {i: sum(x for _, x in s[max(0, n - 4) : n + 1]) for s in by.values() for n, (i, _) in enumerate(s) if n >= 4 or not full}
        for extra in ({}, {"rows": 60, "block": 40}):
            got = W.framed(df, "id", -4, 0, {"s": lambda w: F.sum("x").over(w)}, ["k"], full, **extra)
            assert {r.id: r.s for r in got.collect()} == want and set(got.columns) == {"id", "k", "x", "s"}
    runs = set()
    for k, s in by.items():
        n, last, start, length = -1, None, None, 0
        for i, x in [*s, (None, object())]:
            if x != last:
                if length:
                    runs.add((k, n, last, length, start))
                n, last, start, length = n + 1, x, i, 0
            length += 1
    for extra in ({}, {"rows": 60}):
        assert {(r.k, r.run, r.x, r.length, r["first"]) for r in A.runs(df, "x", "id", ["k"], **extra).collect()} == runs
    quotes = df.where("id % 4 = 0").select("k", F.col("id").alias("t"), F.col("x").alias("q")).where("id % 20 <> 0 OR x > 0")
    have = {(r.k, r.t): r.q for r in quotes.collect()}
    want = {}
    for k, s in by.items():
        last = None
        for i, _ in s:
            last = have.get((k, i), last)
            want[i] = last
    for extra in ({}, {"rows": 60}):
        assert {r.id: r.found for r in J.asof_join(df, quotes, "k", "id", "t", "q", "found", **extra).collect()} == want


def test_running_values_of_hot_symbols(spark):
    rng = np.random.default_rng(10)
    rows = [(i, None if i % 40 == 3 else "hot" if i % 4 else "b", float(rng.integers(1, 90)), 1.0) for i in range(1500)]
    df = spark.createDataFrame(rows, "ts long, symbol string, price double, volume double").repartition(4)
    by = {}
    for _, k, p, _ in rows:
        by.setdefault(k, []).append(p)
    want = {k: float(((np.array(v) - np.maximum.accumulate(v)) / np.maximum.accumulate(v)).min()) for k, v in by.items()}
    bars = {(k, b): (v[100 * b], max(v[100 * b : 100 * b + 100])) for k, v in by.items() for b in range(len(v) // 100)}
    for extra in ({}, {"rows": 70}):
        assert {r.symbol: r.max_drawdown for r in M.max_drawdown(df, **extra).collect()} == pytest.approx(want)
        assert {(r.symbol, r.bar): (r.open, r.high) for r in M.resample_ohlc(df, 100, **extra).collect()} == bars
