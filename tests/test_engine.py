import json

import pytest

from sluice import queries, storage
from sluice.engine import Engine, ToolError
from sluice.operators import audit
from sluice.operators import writes
from sluice.operators.audit import Audit, redacted, shown
from sluice.sources import registry, tables
from sluice.streaming import sessions


@pytest.fixture
def engine(spark, sf, tmp_path):
    tables = {t: f"{sf}/{t}.parquet" for t in ("customer", "nation", "orders")}
    known = registry.from_records([queries.record("dev-main", "dev", write_enabled=True, max_rows=5), queries.record("prod-main", "prod", **queries.MASKED), queries.record("lab", "lab", state={"runtime_status": "vault_locked"}), queries.record("off", "ops", status="disabled")])
    e = Engine(spark, known, {t.target_id: tables for t in known.list()}, env={"DB_MAIN": "x", "ANON_HASH_SALT": "s"}, audit=Audit("debug", silent=True), scratch=str(tmp_path))
    yield e
    e.close()


def test_read(engine):
    r = engine.read("dev-main", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey", max_rows=999)
    assert (r.row_count, r.total_rows_before_limits, r.max_rows_applied, r.truncated, r.anonymization_applied) == (5, 150, 5, True, False)
    assert [x["c_custkey"] for x in r.rows] == list("01234") and r.columns[0]["type"] == "bigint"
    assert r.result_bytes == len(json.dumps(r.rows, separators=(",", ":")).encode())
    assert [e["event"] for e in engine.audit.events] == ["query_in", "db_driver_start", "db_driver_done", "query_out"]
    assert [r.event for r in audit.table(engine.spark, engine.audit.events).collect()][-1] == "query_out"
    assert "SELECT" in engine.audit.events[0]["payload"]["sql_preview"] and "Customer#" not in json.dumps(engine.audit.events)


def test_masked_read(engine):
    r = engine.read("prod-main", "SELECT c_custkey, c_name AS email, c_nationkey FROM customer WHERE c_nationkey = @n", {"n": 3})
    assert r.anonymization_applied and all(x["email"].endswith("@example.invalid") and x["c_nationkey"] == 3 for x in r.rows)
    assert [e["event"] for e in engine.audit.events][2:5] == ["db_driver_done", "anonymizer_start", "anonymizer_done"]


@pytest.mark.parametrize("target,sql,code", [("x", "SELECT 1", "target_not_found"), ("off", "SELECT 1", "policy_denied"), ("dev-main", "DELETE FROM nation", "invalid_sql"), ("dev-main", "SELECT x FROM nowhere", "db_read_failed"), ("lab", "SELECT 1", "db_read_failed"), ("dev-main", "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`", "db_read_failed")])
def test_refusals(engine, target, sql, code):
    with pytest.raises(ToolError) as error:
        engine.read(target, sql)
    assert error.value.code == code and error.value.envelope()["error"]["code"] == code
    assert [e["event"] for e in engine.audit.events] == ["query_failed"]


def test_missing_binding(spark):
    assert tables.parquet("/a/", ["t"]) == {"t": "/a/t.parquet"}
    e = Engine(spark, queries.registry(), {}, env={})
    with pytest.raises(ToolError, match='Missing runtime environment variable "DB_MAIN"'):
        e.read("dev-main", "SELECT 1 AS a")


def test_writes(engine):
    count = lambda where="true": engine.query("dev-main", f"SELECT count(*) AS n FROM customer WHERE {where}").first().n
    before = count("c_nationkey = 3")
    assert engine.write("dev-main", "UPDATE customer SET c_name = 'X' WHERE c_nationkey = @n", {"n": 3}).rows_affected == before == count("c_name = 'X'")
    assert engine.write("dev-main", "DELETE FROM customer WHERE c_name = 'X'").rows_affected == before and count() == 150 - before
    assert engine.write("dev-main", "INSERT INTO customer (c_custkey, c_name) VALUES (9001, 'a'), (9002, NULL)").rows_affected == 2 and count() == 152 - before
    merged = engine.write("dev-main", "MERGE INTO customer AS t USING (SELECT 9001L AS k UNION ALL SELECT 9003L) AS s ON t.c_custkey = s.k WHEN MATCHED THEN DELETE WHEN NOT MATCHED THEN INSERT (c_custkey) VALUES (s.k)")
    assert merged.rows_affected == 2 and count("c_custkey >= 9000") == 2
    for sql in ("DROP TABLE customer", "UPDATE customer SET nothing = 1", "SELECT 1"):
        with pytest.raises(ToolError):
            engine.write("dev-main", sql)
    with pytest.raises(ToolError, match="Write access"):
        engine.write("prod-main", "DELETE FROM customer")


def test_diagnosis_and_tools(engine):
    out = engine.diagnose("dev", "SELECT n_name FROM nation ORDER BY n_name", ticket_key="   ")
    assert out["blockers"] == [] and out["summary"]["ticket_key"] is None and len(out["summary"]["sample_rows"]) == 3
    assert "Unknown target_id" in engine.diagnose("dev", "SELECT 1", target_id="x")["blockers"][0]
    assert "Only SELECT" in engine.diagnose("dev", "DROP TABLE t")["blockers"][0]
    assert len(engine.targets()) == 4 and engine.target_info("dev-main")["effective_limits"]["max_rows"] == 5
    assert sum(map(len, engine.tool_info()["tool_map"].values())) == 7
    with pytest.raises(ToolError, match="disabled"):
        engine.target_info("off")


def test_redaction():
    assert redacted("query_out", {"row_count": 1, "response": {"rows": [1]}}, "debug").keys() == {"tool", "target_id", "row_count", "rows_affected", "truncated", "anonymization_applied", "anonymization_provider", "anonymization_mode"}
    assert redacted("query_in", {"sql": "SELECT 1", "parameters": {"b": 1, "a": 2}}, "info")["parameter_keys"] == ["a", "b"]
    assert [shown("query_in", level) for level in ("error", "info", "debug")] == [False, False, True] and not shown("query_out", "error")


def test_session_store():
    now = [0]
    store = sessions.SessionStore(100, lambda: now[0])
    store.set("a", 1)
    store.set("b", 2, ttl_ms=0)
    now[0] = 99
    assert store.get("a") == 1 and store.touch("a")
    now[0] = 199
    assert store.prune() == ["a"] and store.get("a") is None and not store.touch("a") and store.drain() == {"b": 2} and len(store) == 0


def test_session_stream(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts")
    source.write.parquet(str(tmp_path / "in"))
    stream = sessions.windows(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")), 3600)
    query = stream.writeStream.format("memory").queryName("session_windows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = {tuple(r) for r in sessions.windows(source.withColumn("ts", source.ts.cast("timestamp")), 3600).collect()}
    streamed = {tuple(r) for r in spark.table("session_windows").collect()}
    assert streamed and streamed <= batch


def test_merge_refuses_several_matches(engine):
    many = "MERGE INTO customer AS t USING (SELECT 5L AS k, 'a' AS v UNION ALL SELECT 5L, 'b' UNION ALL SELECT 9009L, 'c' UNION ALL SELECT 9009L, 'd') AS s ON t.c_custkey = s.k "
    with pytest.raises(ToolError, match="the same row more than once"):
        engine.write("dev-main", many + "WHEN MATCHED THEN UPDATE SET c_name = s.v")
    assert engine.write("dev-main", many + "WHEN NOT MATCHED THEN INSERT (c_custkey, c_name) VALUES (s.k, s.v)").rows_affected == 2


def test_writes_last_and_none_is_lost(engine, spark):
    other = Engine(spark, engine.registry, engine.tables, env=engine.env, scratch=engine.scratch)
    count = lambda e: e.query("dev-main", "SELECT count(*) AS n FROM customer WHERE c_name = 'new'").first().n
    assert count(other) == 0
    assert engine.write("dev-main", "WITH x AS (SELECT 8000L AS k) INSERT INTO customer (c_custkey, c_name) SELECT k, 'new' FROM x").rows_affected == 1
    later = Engine(spark, engine.registry, engine.tables, env=engine.env, scratch=engine.scratch)
    assert count(later) == 1 and later.write("dev-main", "UPDATE customer SET c_name = 'new' WHERE c_custkey = 3").rows_affected == 1
    # a plan that was made before another writer's commit is refused, whatever it would have written
    stale = other.plan_write("dev-main", "DELETE FROM customer WHERE c_custkey = 4")
    assert later.write("dev-main", "UPDATE customer SET c_name = 'new' WHERE c_custkey = 3").rows_affected == 1
    assert count(other) == 2  # reads are fresh
    with pytest.raises(writes.LostUpdate):
        other._sessions["dev-main"][1].apply(stale)
    assert other.write("dev-main", "DELETE FROM customer WHERE c_custkey = 4").rows_affected == 1 and count(other) == 2


@pytest.mark.parametrize("sql", ["SELECT c_custkey FROM (SELECT TOP 5 PERCENT c_custkey FROM customer ORDER BY c_name) x", "SELECT TOP 5 PERCENT c_custkey FROM customer UNION ALL SELECT 1", "SELECT TOP 101 PERCENT c_custkey FROM customer", "SELECT c_name FROM customer WHERE c_name LIKE '[AB]%'", "SELECT (c_custkey + 1) / 2 AS x FROM customer", "SELECT concat(c_name, '1') / 2 + '1' FROM customer", "SELECT CONVERT(varchar(10), c_custkey, 1) FROM customer", "SELECT DISTINCT TOP 2 WITH TIES c_name FROM customer ORDER BY c_name"])
def test_forms_that_are_refused(engine, sql):
    with pytest.raises(ToolError) as error:
        engine.query("dev-main", sql)
    assert error.value.code == "invalid_sql"


def test_spellings_leave_literals_alone(engine):
    row = engine.query("dev-main", "SELECT 'SELECT TOP 1 x + LEN(' + 'CROSS APPLY (' AS t, DATE'2024-01-31' + 1 AS d, DATEDIFF(year, '2023-12-31', '2024-01-01') AS y, DATEDIFF(week, DATE'2024-01-06', DATE'2024-01-07') AS w").first()
    more = engine.query("dev-main", "SELECT 1 + '2' AS a, 7/2 AS b, -7/2 AS c, 7/2. AS d, 'x' + 'y' AS e, '1' + '2' AS f, c_custkey + '1' AS g, c_custkey / 2 AS h, c_name + N'!' AS i FROM customer WHERE c_custkey = 5").first()
    assert (more.a, more.b, more.c, float(more.d), more.e, more.f, more.g, more.h, more.i) == (3, 3, -3, 3.5, "xy", "12", 6, 2, "Customer#000000005!")
    given = engine.query("dev-main", "SELECT @n / 2 AS a, @x / 2 AS b, @t + '1' AS c, c_custkey / @n AS d FROM customer WHERE c_custkey = 9", {"n": 7, "x": 7.0, "t": "5"}).first()
    assert (given.a, given.b, given.c, given.d) == (3, 3.5, "51", 1)
    assert (row.t, str(row.d), row.y, row.w) == ("SELECT TOP 1 x + LEN(CROSS APPLY (", "2024-02-01", 1, 1)


BOTH = [(1, "x"), (2, "y"), (3, "z")]
MERGES = {
    "WHEN NOT MATCHED THEN INSERT (k, v) VALUES (s.k, s.v)": [*BOTH, (4, "n"), (4, "m")],
    "WHEN MATCHED AND s.n > 5 THEN UPDATE SET v = s.v": BOTH,
    "WHEN MATCHED AND s.n > 1 THEN UPDATE SET v = s.v": [(1, "q"), (2, "y"), (3, "z")],
    "WHEN MATCHED AND s.n > 1 THEN DELETE": [(2, "y"), (3, "z")],
    "WHEN NOT MATCHED BY SOURCE THEN DELETE": [(1, "x")],
    "WHEN NOT MATCHED BY SOURCE AND t.k = 2 THEN UPDATE SET v = 'gone'": [(1, "x"), (2, "gone"), (3, "z")],
    "WHEN MATCHED AND s.n = 2 THEN UPDATE SET v = s.v WHEN NOT MATCHED AND s.n = 9 THEN INSERT (v) VALUES (s.v) WHEN NOT MATCHED BY SOURCE AND t.k = 3 THEN DELETE": [(1, "q"), (2, "y"), (None, "n")],
    "WHEN MATCHED AND s.n = 1 THEN DELETE WHEN MATCHED AND s.n = 1 THEN UPDATE SET v = 'never'": [(2, "y"), (3, "z")],
    "WHEN NOT MATCHED THEN INSERT *": [*BOTH, (4, "n"), (4, "m")],
}


@pytest.fixture
def small(spark, tmp_path):
    spark.createDataFrame(BOTH, "k int, v string").write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([(1, "p", 1), (1, "q", 2), (4, "n", 9), (4, "m", 8), (None, "o", 9)], "k int, v string, n int").where("k is not null").write.parquet(str(tmp_path / "s"))
    e = Engine(spark, registry.from_records([queries.record("dev-main", "dev", write_enabled=True)]), {"dev-main": {n: str(tmp_path / n) for n in "ts"}}, env={"DB_MAIN": "x"}, scratch=str(tmp_path / "w"))
    yield e
    e.close()


def rows_of(e, sql="SELECT * FROM t"):
    return sorted(map(tuple, e.query("dev-main", sql).collect()), key=str)


@pytest.mark.parametrize("clauses", MERGES)
@pytest.mark.parametrize("on", ["t.k = s.k", "t.k <= s.k AND t.k >= s.k"])
def test_merge_with_repeats_in_the_source(small, clauses, on):
    small.write("dev-main", f"MERGE INTO t USING s ON {on} {clauses}")
    assert rows_of(small) == sorted(MERGES[clauses], key=str)


def test_rows_that_a_write_touched(small):
    r = small.write("dev-main", "UPDATE t SET v = upper(v) + '!' OUTPUT deleted.v AS was, inserted.*, inserted.k + @n AS more WHERE k > 1", {"n": 10})
    assert (r.rows_affected, r.row_count, r.truncated) == (2, 2, False) and [c["name"] for c in r.columns] == ["was", "k", "v", "more"]
    assert sorted((x["was"], x["k"], x["v"], x["more"]) for x in r.rows) == [("y", 2, "Y!", 12), ("z", 3, "Z!", 13)]
    assert rows_of(small) == [(1, "x"), (2, "Y!"), (3, "Z!")]
    r = small.write("dev-main", "INSERT INTO t (k, v) OUTPUT inserted.k, $action VALUES (7, 'a'), (8, 'OUTPUT inserted.k')")
    assert sorted(map(str, r.rows)) == ["{'k': 7, '$action': 'INSERT'}", "{'k': 8, '$action': 'INSERT'}"] and len(rows_of(small)) == 5
    r = small.write("dev-main", "DELETE FROM t OUTPUT deleted.k WHERE k >= 7")
    assert sorted(x["k"] for x in r.rows) == [7, 8] and r.result_bytes == len(json.dumps(r.rows, separators=(",", ":")).encode())
    r = small.write("dev-main", "MERGE INTO t USING s ON t.k = s.k WHEN MATCHED AND s.n = 2 THEN UPDATE SET v = s.v WHEN NOT MATCHED AND s.n = 9 THEN INSERT (k, v) VALUES (s.k, s.v) WHEN NOT MATCHED BY SOURCE AND t.k = 3 THEN DELETE OUTPUT $action, deleted.v AS was, inserted.v AS now;")
    assert sorted((x["$action"], x["was"], x["now"]) for x in r.rows) == [("DELETE", "Z!", None), ("INSERT", None, "n"), ("UPDATE", "x", "q")] and r.rows_affected == 3
    assert rows_of(small) == [(1, "q"), (2, "Y!"), (4, "n")]
    r = small.write("dev-main", "DELETE FROM t OUTPUT deleted.k WHERE k = 99")
    assert (r.rows, r.rows_affected, r.result_bytes) == ([], 0, 2) and len(rows_of(small)) == 3
    for sql in ("DELETE FROM t OUTPUT deleted.k INTO s WHERE k = 1", "DELETE FROM t OUTPUT deleted.nothing WHERE k = 1", "DELETE FROM t OUTPUT reflect('java.lang.System', 'exit', deleted.k) WHERE k = 1"):
        with pytest.raises(ToolError):
            small.write("dev-main", sql)


def test_a_statement_with_output_runs_once(small, spark, tmp_path):
    """A value that differs at each evaluation is the same in the table and in what is returned."""
    r = small.write("dev-main", "UPDATE t SET v = NEWID() OUTPUT inserted.k, inserted.v")
    assert sorted((x["k"], x["v"]) for x in r.rows) == rows_of(small)
    r = small.write("dev-main", "MERGE INTO t USING (SELECT k + 100 AS k, NEWID() AS v FROM s) AS s ON t.k = s.k OR s.v = 'x' WHEN NOT MATCHED THEN INSERT (k, v) VALUES (s.k, s.v) OUTPUT inserted.v")
    assert {x["v"] for x in r.rows} == {v for _, v in rows_of(small, "SELECT k, v FROM t WHERE k > 100")}


def test_log_entries_of_dead_writers(small, spark, tmp_path):
    """An entry without content takes its place; the table stays as the last whole one has it, and goes on."""
    small.write("dev-main", "DELETE FROM t WHERE k = 1")
    (tmp_path / "w/dev-main/t/log/000000002.json").write_text("")
    again = Engine(spark, small.registry, small.tables, env=small.env, scratch=small.scratch)
    assert rows_of(again) == rows_of(small) == BOTH[1:]
    again.write("dev-main", "DELETE FROM t WHERE k = 2")
    assert rows_of(again) == rows_of(small) == BOTH[2:]
    assert not list((tmp_path / "w/dev-main/t/log").glob("*draft*"))


def test_one_writer_takes_a_place(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(8) as pool:
        took = list(pool.map(lambda k: storage.take_place(spark, f"{tmp_path}/log/1.json", str(k)), range(16)))
    assert sum(took) == 1 and (tmp_path / "log/1.json").read_text() == str(took.index(True)) and storage.places(spark, f"{tmp_path}/log") == ["1.json"]


def test_recursion_has_no_limit_of_rows(spark):
    """Spark stops a recursive CTE at 1,000,000 rows unless told otherwise: that many come with larger tables."""
    known = registry.from_records([queries.record("dev-main", "dev")])
    e = Engine(spark, known, {"dev-main": {"big": spark.range(400_000)}}, env={"DB_MAIN": "x"})
    found = e.query("dev-main", "WITH t(k, n) AS (SELECT id, 0 FROM big UNION ALL SELECT k, n + 1 FROM t WHERE n < 2) SELECT n, count(*) AS c FROM t GROUP BY n")
    assert sorted(map(tuple, found.collect())) == [(0, 400_000), (1, 400_000), (2, 400_000)]
    e.close()
