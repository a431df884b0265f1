"""The operators that stand beside SQL: prefixes, interval and as-of joins, sketches, recursion, remote reads, sessions on a stream."""

import json
import random
import re
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluice import queries
from sluice.operators import asof, classify, prefixes, range_join, reach, results, sketches
from sluice.sources import tables
from sluice.sources.settings import Settings
from sluice.streaming import sessions


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_prefix_of_a_whole_table(spark, sf):
    rows = prefixes.placed(results.normalized(spark.read.parquet(f"{sf}/lineitem.parquet").drop("l_quantity", "l_extendedprice", "l_discount", "l_tax")).repartition(5, "l_orderkey"))
    numbered = rows.orderBy(results.PLACE).toPandas().reset_index(drop=True)
    sizes = [len(json.dumps({k: v for k, v in r.items() if k != results.PLACE}, separators=(",", ":"))) for r in numbered.to_dict("records")]
    sums = [1 + sum(sizes[: k + 1]) + k + 1 for k in range(0, len(sizes), 997)]
    assert sum(sizes) > 400_000
    for most in (10, sizes[0], sizes[0] + 2, 5_000, 100_000, 333_333, 10**9):
        found = prefixes.within_bytes(rows, most)
        n = found.count()
        fits = next((k for k in range(len(sizes)) if (sizes[0] if k == 0 else 2 + sum(sizes[: k + 1]) + k) > most), len(sizes))
        assert n == fits and (not n or found.agg(F.max("result_bytes")).first()[0] == 2 + sum(sizes[:n]) + n - 1)
        strict = prefixes.within_bytes(rows, most, lenient_first=False).count()
        assert strict == next((k for k in range(len(sizes)) if 2 + sum(sizes[: k + 1]) + k > most), len(sizes))
    assert sums == sorted(sums)
    assert "SinglePartition" not in plan(prefixes.within_bytes(rows, 100_000)) and "Exchange SinglePartition" not in plan(prefixes.first_rows(rows, 2000))


def test_prefix_equals_the_bounded_result(spark, sf):
    df = results.capped(results.normalized(spark.read.parquet(f"{sf}/lineitem.parquet").coalesce(1)), 6000)
    want = results.bounded(df, 123_456)
    got = prefixes.within_bytes(df.withColumn(results.PLACE, F.col(results.PLACE)), 123_456)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("percent", [0, 0.01, 12.5, 50, 100])
@pytest.mark.parametrize("ties", [False, True])
def test_top_percent(spark, percent, ties):
    random.seed(2)
    values = [random.choice([None, *range(9)]) for _ in range(150)]
    df = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v int, k int").repartition(7)
    n = -int(-len(values) * percent // 100)
    order = sorted(values, key=lambda v: (v is not None, v or 0))
    if ties and n:
        n = max(k + 1 for k, v in enumerate(order) if v == order[n - 1])
    got = [r.v for r in prefixes.top_percent(df, percent, [F.asc("v")], ties, ["v"]).collect()]
    assert got == order[:n]
    assert prefixes.top_percent(df.limit(0), percent, [F.asc("v")], ties, ["v"]).count() == 0


@pytest.mark.parametrize("keyed", [False, True])
def test_intervals(spark, keyed):
    random.seed(4)
    start = datetime(2024, 1, 1)
    at = lambda: start + timedelta(seconds=random.randint(-5000, 5000), microseconds=random.choice([0, 1, 999_999]))
    points = [(k, k % 3, at() if k % 11 else None) for k in range(120)] + [(3, 0, start), (3, 0, start)]
    held = [(k, k % 3 if k % 13 else None, a := at(), random.choice([a, a + timedelta(microseconds=1), a + timedelta(seconds=random.choice([1, 60, 4000, 100_000])), None, a - timedelta(seconds=5)])) for k in range(80)]
    p = spark.createDataFrame(points, "p int, g int, at timestamp")
    i = spark.createDataFrame(held, "i int, g int, start timestamp, end timestamp")
    found = range_join.interval_join(p, i if keyed else i.drop("g"), "at", "start", "end", ["g"] if keyed else [])
    want = sorted((a, b) for a, g, t in points for b, h, s, e in held if t and s and e and s <= t < e and (not keyed or g == h))
    assert sorted((r.p, r.i) for r in found.collect()) == want and len(want) > 100
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert range_join.interval_join(p, i.drop("g").limit(0), "at", "start", "end").count() == 0
    numbers = range_join.interval_join(spark.range(-5, 50), spark.createDataFrame([(-3, 4), (10, 11), (7, 7)], "a int, b int"), "id", "a", "b")
    assert sorted(r.id for r in numbers.collect()) == [*range(-3, 4), 10]


@pytest.mark.parametrize("slices", [1, 2, 16])
def test_asof_of_hot_keys(spark, slices):
    random.seed(6)
    left = [(k, random.choice([1, 1, 1, 2, 3, None]), random.choice([None, *range(60)])) for k in range(200)] + [(7, 1, 5), (7, 1, 5)]
    right = [(k, random.choice([1, 1, 1, 2, 9, None]), random.choice([None, *range(5, 50)])) for k in range(120)]
    a, b = spark.createDataFrame(left, "a int, k int, t int"), spark.createDataFrame(right, "b int, j int, s int")
    found = asof.asof_join(a, b, ("k", "j"), ("t", "s"), ["b"], slices)
    last = lambda k, t: max(((s, x) for x, j, s in right if k is not None and t is not None and j == k and s is not None and s <= t), default=(None, None))[1]
    assert found.columns == ["a", "k", "t", "b"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(((x, k, t, last(k, t)) for x, k, t in left), key=str)
    if slices > 2:  # rows are dealt out by key and slice, and only one row for each of these by key alone
        assert re.search(r"hashpartitioning\(__key#\d+L?, __slice#\d+", plan(found))


def test_daily_sketches(spark, tmp_path):
    rows = spark.range(40_000).select((F.col("id") % 7000).alias("v"), (F.col("id") % 2).alias("g"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 10).cast("int")).alias("day"))
    held = sketches.DailySketches(spark, str(tmp_path / "s"), "v", ["g"])
    assert len(held.add(rows.where("day < '2024-01-04'"), "day")) == 3
    assert held.add(rows.where("day < '2024-01-04'"), "day") == []  # nothing is counted again
    assert len(held.add(rows.union(rows.limit(5).withColumn("day", F.lit(None).cast("date"))), "day")) == 7
    exact = {r.g: r.n for r in rows.groupBy("g").agg(F.count_distinct("v").alias("n")).collect()}
    about = {r.g: r.about for r in held.counts().collect()}
    assert all(abs(about[g] / n - 1) < 0.03 for g, n in exact.items())
    days = {r.g: r.about for r in held.counts("2024-01-02", "2024-01-03").collect()}
    some = {r.g: r.n for r in rows.where("day in ('2024-01-02', '2024-01-03')").groupBy("g").agg(F.count_distinct("v").alias("n")).collect()}
    assert days.keys() == some.keys() and all(abs(days[g] / n - 1) < 0.03 for g, n in some.items())
    assert "PushedFilters: [IsNotNull(day), GreaterThanOrEqual(day" in plan(held.counts("2024-01-02", "2024-01-03"))


def test_reach(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (1, 2), (7, 8), (None, 9), (2, None), (6, 6)], "a int, b int")
    start = spark.createDataFrame([(1,), (1,), (20,), (None,)], "node int")
    assert {tuple(r) for r in reach.reach(links, start).collect()} == {(1, 0), (20, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5)}
    assert {r.node for r in reach.reach(links, start, most=2).collect()} == {1, 20, 2, 3}
    assert reach.reach(links.limit(0), start).count() == 2 and reach.reach(links, start.limit(0)).count() == 0


def test_remote_reads(spark, sf):
    """An embedded database: parts of about equal size, whose filters and columns it works out itself."""
    url = f"jdbc:derby:memory:{tempfile.mktemp(prefix='d', dir='')};create=true"
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.expr("CASE WHEN o_orderkey < 1000 THEN o_orderkey WHEN o_orderkey < 1400 THEN 5000 + o_orderkey * 100 END").alias("K"), F.col("o_custkey").alias("C"), F.col("o_totalprice").alias("P"))
    orders.coalesce(1).write.jdbc(url, "ORDERS")
    settings, sql = Settings(pool_max=6), "SELECT K, C, P FROM ORDERS"
    conditions = tables.ranges(spark, settings, url, sql, "K", 5)
    df = tables.remote(spark, settings, url, sql, "K", 5)
    assert 2 <= len(conditions) == df.rdd.getNumPartitions() <= 5
    assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, orders.collect()), key=str)
    few = df.where("C = 3").select("P")
    assert "EqualTo(C,3)" in plan(few) and "ReadSchema: struct<P:double>" in plan(few)
    assert sorted(r.P for r in few.collect()) == sorted(r.P for r in orders.where("C = 3").collect())
    assert tables.ranges(spark, settings, url, "SELECT K FROM ORDERS WHERE C < 0", "K", 5) == ["1 = 1"]
    whole = tables.jdbc(spark, settings, url, sql, column="K", low=0, high=200_000, parts=40)
    assert whole.rdd.getNumPartitions() == 6 and whole.count() == orders.count()


def test_first_rows_and_count_in_one_read(spark, sf):
    e = queries.engine(spark, sf, "lineitem")
    r = e.read("dev-main", "SELECT l_orderkey, l_linenumber FROM lineitem", max_rows=50)
    assert (r.row_count, r.total_rows_before_limits, r.truncated) == (50, 6000, True)
    assert plan(r.frame).count("Scan parquet") == 1
    r = e.read("dev-main", "SELECT l_orderkey FROM lineitem WHERE l_orderkey < 0")
    assert (r.rows, r.total_rows_before_limits, r.truncated) == ([], 0, False)


def test_profiles_shuffle_no_values(spark, sf):
    df = queries.ask(spark, sf, "SELECT * FROM customer")
    text = plan(classify.profile_columns(df))
    assert text.count("Exchange") == 1 and "hashpartitioning(key" in text
    df = spark.createDataFrame([(str(k % n), "x") for n in (1, 16, 17, 60, 300) for k in range(600)], "a string, b string")
    for n in (1, 15, 16, 17, 40, 300):
        got = {r.key: (r.n_distinct, r.n_all) for r in classify.profile_columns(df.where(F.col("a").cast("int") < n)).collect()}
        assert got["a"] == (min(n, 16), min(n, 17)) and got["b"] == (1, 1)


def session_commands():
    t = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    return [
        [("a", t(0), "set", "A", 10_000), ("b", t(0), "set", "B", 0), ("c", t(1), "touch", None, 5_000), ("d", t(1), "set", "D", 3_000), (None, t(1), "set", "x", 1)],
        [("a", t(5), "touch", None, 10_000), ("d", t(6), "touch", None, 9_000), ("e", t(6), "set", "E", 100_000)],
        [("e", t(7), "delete", None, None), ("f", t(40), "set", "F", None)],
        [("e", t(41), "set", "E2", 1_000), ("f", t(60), "touch", None, 0)],
    ]


def test_sessions_on_a_stream(spark, tmp_path):
    """set, touch, delete, a time to live of 0 and the end of time; each batch goes on from the checkpoint of a stream that stopped."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", "2")
    schema = "session string, at timestamp, op string, value string, ttl_ms long"
    said = []
    for batch in session_commands():
        own.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = sessions.ttl_stream(own.readStream.schema(schema).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(180)
        rows = {(r.session, r.value, r.n_touches, r.alive) for r in own.read.parquet(str(tmp_path / "out")).collect()}
        said.append(rows.difference(*said))
    assert said[0] == {("a", "A", 1, True), ("b", "B", 1, True), ("d", "D", 1, True)}
    assert said[1] >= {("a", "A", 2, True), ("e", "E", 1, True)} and ("d", "D", 1, False) in said[1]  # d had ended when it was touched
    ended = set().union(*said)
    assert {("e", "E", 1, False), ("f", "F", 1, True), ("a", "A", 2, False), ("f", "F", 2, True)} <= ended
    assert not any(s == "b" and not alive for s, _, _, alive in ended) and not any(s == "c" for s, *_ in ended)
    assert ("e", "E2", 1, False) in ended


@pytest.mark.parametrize("keyed", [False, True])
def test_intervals_in_a_hot_bin_are_tiled(spark, monkeypatch, keyed):
    """Points of a bin travel as blocks of a few, and tiles of a bin meet in tasks of their own, each pair once."""
    monkeypatch.setattr(range_join, "HELD", 4)
    monkeypatch.setattr(range_join, "TILE", 8)
    points = [(k, k % 2, 1000 + k // 3 if k % 5 else 1003) for k in range(200)]
    held = [(k, k % 2, a := 990 + k % 40, a + [1, 3, 30, 64, 0][k % 5]) for k in range(60)]
    p, i = spark.createDataFrame(points, "p int, g int, at long"), spark.createDataFrame(held, "i int, g int, start long, end long")
    p = p.withColumn("held", F.create_map(F.lit("k"), "p"))  # what can't be hashed travels too
    found = range_join.interval_join(p, i if keyed else i.drop("g"), "at", "start", "end", ["g"] if keyed else [])
    want = sorted((a, b) for a, g, t in points for b, h, s, e in held if s <= t < e and (not keyed or g == h))
    assert sorted((r.p, r.i) for r in found.where("held['k'] = p").collect()) == want and len(want) > 1000
    assert "inline(__points" in plan(found) and "__row" in plan(found)


def test_intervals_are_written_in_little_space(spark, tmp_path):
    """Rows come block by block, so that their columns repeat; points go to the bins of several lengths once they are packed."""
    p = spark.range(20_000).select("id", (F.col("id") * 7919 % 20_000).alias("at"))
    i = spark.range(150).select(F.col("id").alias("i"), (F.col("id") % 3).alias("start"), (F.when(F.col("id") < 2, 500).otherwise(20_000) + F.col("id") % 5).alias("end"))
    found = range_join.interval_join(p, i, "at", "start", "end").select("id", "i")
    found.write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out"))
    want = p.join(i, (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end"))).select("id", "i")
    sums = [F.count("*"), F.expr("bit_xor(xxhash64(id, i))"), F.sum(F.hash("id", "i").cast("long"))]
    assert rows.agg(*sums).first() == want.agg(*sums).first()
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.4 * rows.count()
    assert not re.search(r"Exchange hashpartitioning\([^\n]*__slice", plan(found.agg(F.count("id"))))


def test_sessions_travel_in_one_column(spark, tmp_path):
    """Python gets a session's commands as one column beside key and time, with any text in them, and state along with them."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "2")
    t = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    odd = 'a "quote",\n\\ and é\U0001f600'
    schema = "session string, at timestamp, op string, value string, ttl_ms long"
    own.createDataFrame([("s", t(3), "touch", None, 2_000), ("s", t(1), "set", odd, 9_000), (odd, t(2), "set", None, 0)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sessions.ttl_stream(own.readStream.schema(schema).parquet(str(tmp_path / "in")))
    text = stream._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState" in text and "TransformWithState" not in text
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(180)
    rows = {tuple(r) for r in own.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {("s", odd, t(3), 2, t(5), True), (odd, None, t(2), 1, None, True)}
