"""Queries over the test tables, each through the engine's own path, and the SQL that each equals."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import storage
from sluice.engine import Engine
from sluice.functions import masks, text
from sluice.operators import asof, audit, classify, prefixes, range_join, reach, results, sketches
from sluice.operators.mask import masked_frame
from sluice.plans import policy
from sluice.sources.registry import Registry, from_records
from sluice.streaming import sessions

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SALT = "pepper"
TOOLS = ["db_target_info", "db_policy_info", "db_read", "db_write"]


def record(target_id: str, environment: str, **more: object) -> dict[str, object]:
    base = {
        "target_id": target_id, "display_name": target_id, "environment": environment, "db_kind": "spark", "status": "active", "connection_env_var": "DB_MAIN",
        "read_enabled": True, "write_enabled": False, "anonymization_enabled": False, "anonymization_mode": "off", "llm_provider": "none", "llm_model": "",
        "max_rows": 200, "max_result_bytes": 262144, "allowed_tools": TOOLS,
    }
    return base | more


MASKED = {"anonymization_enabled": True, "anonymization_mode": "deterministic", "llm_provider": "ollama", "llm_model": "m"}


def registry() -> Registry:
    return from_records(
        [
            record("dev-main", "dev", write_enabled=True),
            record("prod-main", "prod", max_rows=100, max_result_bytes=131072, **MASKED),
            record("prod-two", "prod", read_enabled=False, connection_env_var="DB_TWO"),
            record("ops-archive", "ops", status="disabled", allowed_tools=["db_target_info"]),
            record("lab", "lab", state={"runtime_status": "vault_locked", "last_synced_at": None, "last_error": "sealed"}),
        ]
    )


def engine(spark: SparkSession, sf_dir: str, sql: str = "") -> Engine:
    """An engine whose targets have the tables that the text names."""
    named = {t: f"{sf_dir}/{t}.parquet" for t in TABLES if re.search(rf"\b{t}\b", sql)}
    return Engine(spark, registry(), {t.target_id: named for t in registry().list()}, env={"DB_MAIN": "local", "ANON_HASH_SALT": SALT})


def ask(spark: SparkSession, sf_dir: str, sql: str, parameters: dict[str, object] | None = None) -> DataFrame:
    return engine(spark, sf_dir, sql).query("dev-main", sql, parameters)


#: Guarded reads by name: the text, and the SQL that it equals where that is spelled otherwise.
READS: dict[str, tuple[str, str | None]] = {
    "guarded_select": ("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey = 3 AND c_acctbal BETWEEN 0 AND 5000", None),
    "guarded_cte": (";WITH big AS (SELECT o_custkey, o_totalprice FROM dbo.orders WHERE o_totalprice > 300000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey;", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey"),
    "quoted_names": ("SELECT [c_custkey] AS [EXEC], \"c_name\" AS \"INTO\" FROM [dbo].[customer] WHERE c_name <> 'DROP TABLE -- x'", "SELECT c_custkey AS \"EXEC\", c_name AS \"INTO\" FROM customer WHERE c_name <> 'DROP TABLE -- x'"),
    "values_scan": ("SELECT c_custkey, t.b FROM customer JOIN (VALUES (1, 'x'), (2, 'y'), (7, 'z')) AS t(a, b) ON c_nationkey = t.a", None),
    "distinct_in_like_case": ("SELECT DISTINCT o_orderpriority, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'open' ELSE 'done' END AS state FROM orders WHERE o_orderpriority LIKE '%I%' AND o_custkey IS NOT NULL", None),
    "join_inner": ("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", None),
    "join_left": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000", None),
    "join_right": ("SELECT c_custkey, n_nationkey FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 9000", None),
    "join_full": ("SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey", None),
    "join_semi": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')", None),
    "join_anti": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", None),
    # the second part meets a null, which leaves no row
    "join_not_in": ("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 9) UNION ALL SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN s_suppkey > 5 THEN s_nationkey END FROM supplier)", None),
    "join_cross": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "join_theta": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_lateral": ("SELECT c_custkey, x.n FROM customer, LATERAL (SELECT count(*) AS n FROM orders WHERE o_custkey = c_custkey) x", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer"),
    "join_asof": (
        "WITH both AS (SELECT o_custkey AS k, o_orderdate AS at, o_orderkey AS seen, CAST(NULL AS BIGINT) AS event FROM orders UNION ALL SELECT user_id, CAST(ts AS TIMESTAMP), NULL, event_id FROM events)"
        " SELECT event AS event_id, seen AS o_orderkey FROM (SELECT event, last_value(seen) IGNORE NULLS OVER (PARTITION BY k ORDER BY at, coalesce(seen, 9223372036854775807) ROWS UNBOUNDED PRECEDING) AS seen FROM both) t WHERE event IS NOT NULL",
        "SELECT event_id, (SELECT o_orderkey FROM orders WHERE o_custkey = user_id AND o_orderdate <= ts ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS o_orderkey FROM events",
    ),
    "agg_group": ("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10", None),
    "agg_distinct": ("SELECT c_nationkey, count(DISTINCT c_mktsegment) AS segments FROM customer GROUP BY c_nationkey", None),
    "agg_strings": ("SELECT n_regionkey, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "rollup": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", None),
    "cube": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    "grouping_sets": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", None),
    "pivot": ("SELECT * FROM (SELECT o_orderstatus, o_orderpriority FROM orders) PIVOT (count(*) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY 1"),
    "unpivot": ("SELECT n_name, k, v FROM nation UNPIVOT (v FOR k IN (n_nationkey, n_regionkey))", "SELECT n_name, 'n_nationkey' AS k, n_nationkey AS v FROM nation UNION ALL SELECT n_name, 'n_regionkey', n_regionkey FROM nation"),
    "window_rank": ("SELECT c_custkey, row_number() OVER w AS rn, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER w AS q FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)", None),
    "window_lag": ("SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after, first_value(o_orderkey) OVER w AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", None),
    "window_share": ("SELECT c_custkey, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey)", None),
    "window_frame": ("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS recent, count(*) OVER (PARTITION BY user_id ORDER BY value RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM events", None),
    "topk": ("SELECT TOP 10 c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10"),
    "topk_ties": ("SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part) t WHERE r <= 3", None),
    "top_in_branches": (
        "SELECT TOP 1 c_nationkey AS k FROM customer WHERE c_custkey = 7 UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT TOP (3) n_nationkey + 100 FROM nation WHERE n_nationkey < 3 ORDER BY k",
        "SELECT c_nationkey AS k FROM customer WHERE c_custkey = 7 UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey + 100 FROM nation WHERE n_nationkey < 3",
    ),
    "top_in_cte": (
        "WITH rich AS (SELECT TOP 20 c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey) SELECT TOP 5 c_custkey FROM rich WHERE c_custkey IN (SELECT TOP 50 PERCENTS.c_custkey FROM customer AS PERCENTS ORDER BY PERCENTS.c_acctbal DESC, PERCENTS.c_custkey) ORDER BY c_custkey",
        "WITH rich AS (SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20) SELECT c_custkey FROM rich ORDER BY c_custkey LIMIT 5",
    ),
    "top_with_ties": ("SELECT TOP 7 WITH TIES p_partkey, p_size AS s FROM part AS p ORDER BY p.p_size DESC", "SELECT p_partkey, p_size AS s FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 7"),
    "top_percent": ("SELECT TOP 7.5 PERCENT c_custkey AS k, c_acctbal FROM customer AS c ORDER BY c.c_acctbal DESC, k", "SELECT k, c_acctbal FROM (SELECT c_custkey AS k, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r, count(*) OVER () AS n FROM customer) WHERE r <= ceil(n * 0.075)"),
    "top_percent_ties": ("SELECT TOP (12) PERCENT WITH TIES p_partkey, p_size FROM part WHERE p_partkey > 3 ORDER BY p_size", "SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size) AS r, count(*) OVER () AS n FROM part WHERE p_partkey > 3) WHERE r <= ceil(n * 0.12)"),
    "top_ties_by_alias": ("SELECT TOP 3 WITH TIES c_nationkey, count(*) AS c FROM customer GROUP BY c_nationkey ORDER BY c DESC", "SELECT c_nationkey, c FROM (SELECT c_nationkey, count(*) AS c, rank() OVER (ORDER BY count(*) DESC) AS r FROM customer GROUP BY c_nationkey) WHERE r <= 3"),
    "whole_division": ("SELECT p_partkey, p_size / 4 AS quarter, p_partkey / p_size AS times, p_retailprice / 4 AS price, CAST(7 / 2.0 AS DOUBLE) AS half, p_size + '10' AS more FROM part", "SELECT p_partkey, p_size // 4 AS quarter, p_partkey // p_size AS times, p_retailprice / 4 AS price, 3.5::DOUBLE AS half, p_size + 10 AS more FROM part"),
    "text_columns_plus": ("SELECT c_custkey, c_name + c_mktsegment AS t, N'#' + upper(c_mktsegment) + '1' AS u FROM customer WITH (NOLOCK)", "SELECT c_custkey, c_name || c_mktsegment AS t, '#' || upper(c_mktsegment) || '1' AS u FROM customer"),
    "converted": ("SELECT o_orderkey, CONVERT(VARCHAR(20), o_orderkey) AS k, STUFF(o_orderpriority, 1, 1, 'no. ') AS p, CAST(EOMONTH(o_orderdate, 2) AS NVARCHAR(10)) AS eom, DATEPART(weekday, o_orderdate) AS wd FROM orders", "SELECT o_orderkey, o_orderkey::VARCHAR AS k, 'no. ' || substr(o_orderpriority, 2) AS p, last_day(o_orderdate + INTERVAL 2 MONTH)::VARCHAR AS eom, dayofweek(o_orderdate) + 1 AS wd FROM orders"),
    "recursive_unmarked": (
        "WITH t(k, n) AS (SELECT c_custkey, 0 FROM customer WHERE c_nationkey = 3 UNION ALL SELECT o_orderkey % 149, n + 1 FROM t JOIN orders ON o_custkey = k WHERE n < 2) SELECT DISTINCT k, n FROM t",
        "WITH RECURSIVE t(k, n) AS (SELECT c_custkey, 0 FROM customer WHERE c_nationkey = 3 UNION ALL SELECT o_orderkey % 149, n + 1 FROM t JOIN orders ON o_custkey = k WHERE n < 2) SELECT DISTINCT k, n FROM t",
    ),
    "cross_apply": (
        "SELECT c_custkey, x.total FROM customer CROSS APPLY (SELECT sum(o_totalprice) AS total FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS x WHERE x.total > 0",
        "SELECT o_custkey AS c_custkey, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY o_custkey",
    ),
    "outer_apply": (
        "SELECT c_custkey, x.o_orderkey FROM customer OUTER APPLY (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) x WHERE c_nationkey < 12",
        "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 WHERE c_nationkey < 12",
    ),
    "json_members": ("SELECT e.event_id, j.[key] AS name, j.value AS held, j.type AS kind FROM events AS e CROSS APPLY OPENJSON(e.props) AS j", "SELECT event_id, unnest(json_keys(props)) AS name, json_extract_string(props, '$.' || unnest(json_keys(props))) AS held, 2 AS kind FROM events"),
    "json_query": (
        "SELECT event_id, JSON_QUERY('{\"a\":' + props + ',\"b\":1}', '$.a') AS inside, JSON_QUERY('{\"a\":' + props + ',\"b\":1}', '$.b') AS none FROM events",
        "SELECT event_id, replace(props, ': ', ':') AS inside, NULL::VARCHAR AS none FROM events",
    ),
    "datediff_units": (
        "SELECT o_orderkey, DATEDIFF(year, o_orderdate, timestamp'1998-01-01 00:00:00') AS y, DATEDIFF(qq, o_orderdate, timestamp'1998-01-01 00:00:00') AS q, DATEDIFF(month, o_orderdate, timestamp'1998-01-01 00:00:00') AS m,"
        " DATEDIFF(dd, o_orderdate, timestamp'1998-01-01 00:00:00') AS d, DATEDIFF(hour, dateadd(minute, 59, o_orderdate), timestamp'1998-01-01 00:01:00') AS h, DATEDIFF(minute, dateadd(second, 59, o_orderdate), timestamp'1998-01-01 00:01:00') AS mi FROM orders",
        "SELECT o_orderkey, datediff('year', o_orderdate, TIMESTAMP '1998-01-01 00:00:00') AS y, datediff('quarter', o_orderdate, TIMESTAMP '1998-01-01 00:00:00') AS q, datediff('month', o_orderdate, TIMESTAMP '1998-01-01 00:00:00') AS m,"
        " datediff('day', o_orderdate, TIMESTAMP '1998-01-01 00:00:00') AS d, datediff('hour', o_orderdate + INTERVAL 59 MINUTE, TIMESTAMP '1998-01-01 00:01:00') AS h, datediff('minute', o_orderdate + INTERVAL 59 SECOND, TIMESTAMP '1998-01-01 00:01:00') AS mi FROM orders",
    ),
    "text_plus": ("SELECT c_custkey, '<' + c_name + '/' + c_mktsegment + '>' AS t, LEN(c_name + '   ') AS n FROM customer", "SELECT c_custkey, '<' || c_name || '/' || c_mktsegment || '>' AS t, length(c_name) AS n FROM customer"),
    "offset_fetch": ("SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey OFFSET 5 ROWS FETCH NEXT 4 ROWS ONLY", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 4 OFFSET 5"),
    "union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", None),
    "union": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", None),
    "except": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 9", None),
    "scalar_subquery": ("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)", None),
    "correlated_scalar": ("SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.2 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)", None),
    "recursive_cte": ("WITH RECURSIVE t(k, n) AS (SELECT n_nationkey, 0 FROM nation WHERE n_regionkey = 1 UNION ALL SELECT k + 7, n + 1 FROM t WHERE n < 5) SELECT k, n, n_name FROM t LEFT JOIN nation ON n_nationkey = k", None),
    "string_fns": ("SELECT c_custkey, LEN(c_name) AS n, SUBSTRING(c_name, 1, 4) AS head, CHARINDEX('#', c_name) AS at, REPLACE(c_name, '#', '-') AS dashed, UPPER(c_mktsegment) AS up, concat(c_name, '/', c_mktsegment) AS both, left(c_name, 3) AS l3 FROM customer", "SELECT c_custkey, length(c_name) AS n, substring(c_name, 1, 4) AS head, instr(c_name, '#') AS at, replace(c_name, '#', '-') AS dashed, upper(c_mktsegment) AS up, c_name || '/' || c_mktsegment AS both, left(c_name, 3) AS l3 FROM customer"),
    "date_fns": ("SELECT o_orderkey, DATEPART(year, o_orderdate) AS y, date_part('month', o_orderdate) AS m, datediff(day, o_orderdate, timestamp'2001-01-01 00:00:00') AS d, CAST(EOMONTH(o_orderdate) AS STRING) AS eom, date_format(dateadd(day, 10, o_orderdate), 'yyyy-MM-dd') AS later FROM orders", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, datediff('day', o_orderdate, TIMESTAMP '2001-01-01 00:00:00') AS d, last_day(o_orderdate)::VARCHAR AS eom, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS later FROM orders"),
    "math_fns": ("SELECT p_partkey, abs(p_size - 25) AS a, round(p_retailprice, 1) AS r, ceiling(p_retailprice) AS c, floor(p_retailprice) AS f, power(p_size, 2) AS sq, p_size % 7 AS m FROM part", "SELECT p_partkey, abs(p_size - 25) AS a, round(p_retailprice, 1) AS r, ceil(p_retailprice)::BIGINT AS c, floor(p_retailprice)::BIGINT AS f, power(p_size, 2) AS sq, p_size % 7 AS m FROM part"),
    "null_fns": ("SELECT c_custkey, ISNULL(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS seg, IIF(c_acctbal < 0, 'debt', 'ok') AS state, coalesce(NULL, c_name) AS name FROM customer", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'ok' END AS state, c_name AS name FROM customer"),
    "json_fns": ("SELECT event_id, CAST(JSON_VALUE(props, '$.k') AS INT) AS k, from_json(props, 'k INT').k AS k2 FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(json_extract_string(props, '$.k') AS INT) AS k2 FROM events"),
    "json_unfold": ("SELECT event_id, t.key AS name, t.value AS held FROM events LATERAL VIEW explode(from_json(props, 'map<string,string>')) t AS key, value", "SELECT event_id, unnest(json_keys(props)) AS name, json_extract_string(props, '$.' || unnest(json_keys(props))) AS held FROM events"),
    "array_fns": ("SELECT vec_id, size(embedding) AS n, round(element_at(embedding, 1), 4) AS first FROM embeddings", "SELECT vec_id, len(embedding) AS n, round(embedding[1], 4) AS first FROM embeddings"),
}

#: Approximate counts, compared with the exact ones within their error.
APPROX = ("SELECT l_returnflag, approx_count_distinct(l_partkey) AS about FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_partkey) AS exact FROM lineitem GROUP BY l_returnflag")


def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, APPROX[0])
    about, exact = e.query("dev-main", APPROX[0]), e.query("dev-main", APPROX[1])
    return about.join(exact, "l_returnflag").select("l_returnflag", "exact", (F.abs(F.col("about") / F.col("exact") - 1) < 0.2).alias("close"))


def param_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask(spark, sf_dir, "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = @seg AND c_acctbal > @least AND @flag", {"seg": "BUILDING", "least": 1000, "flag": True})


# results


def row_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey"
    return engine(spark, sf_dir, sql).read("dev-main", sql, max_rows=17).frame


def pre_limit_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT l_orderkey FROM lineitem"
    r = engine(spark, sf_dir, sql).read("dev-main", sql)
    return spark.createDataFrame([(r.row_count, r.total_rows_before_limits, r.max_rows_applied, r.truncated)], "row_count long, total_rows long, max_rows long, truncated boolean")


BOUNDED = "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer ORDER BY c_custkey"


def byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = results.capped(results.normalized(ask(spark, sf_dir, BOUNDED)), 200)
    return results.bounded(first, 4096).drop(results.PLACE)


def byte_clamp_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = results.capped(results.normalized(ask(spark, sf_dir, BOUNDED)), 200)
    return results.bounded(masked_frame(first, SALT), 4096, lenient_first=False).drop(results.PLACE)


def cell_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT event_id, ts, user_id, value, CAST(event_type AS BINARY) AS raw, array(event_id, user_id) AS ids, named_struct('a', user_id, 'at', ts) AS pair FROM events"
    flat = results.normalized(ask(spark, sf_dir, sql))
    return flat.select("event_id", "ts", "user_id", "value", "raw", F.array_join("ids", ",").alias("ids"), F.col("pair.a").alias("pair_a"), F.col("pair.at").alias("pair_at"))


def column_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of an answer, beside how many of its values are there."""
    rows = ask(spark, sf_dir, "SELECT * FROM customer")
    counts = rows.agg(*(F.count(c).alias(c) for c in rows.columns)).unpivot([], rows.columns, "name", "n_values")
    found = spark.createDataFrame([(c["name"], c["nullable"], c["type"]) for c in results.columns_of(rows)], "name string, nullable boolean, type string")
    return found.join(counts, "name")


# classification and masks


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT event_type AS tipo, user_id, value, CAST(NULL AS STRING) AS empty FROM events"
    return classify.profile_columns(ask(spark, sf_dir, sql)).select("key", "n_values", F.col("n_distinct").cast("long").alias("n_distinct"))


def column_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT l.toxic AS hostile, l.quality, concat('OQ', lpad(CAST(l.doc_id AS STRING), 8, '0')) AS codice_ordine, CASE WHEN l.toxic = 1 THEN 'alpha' ELSE 'beta' END AS stato FROM labels l"
    return classify.judged_profiles(ask(spark, sf_dir, sql)).select("key", "flag_like", "code_like", "enum_like")


def field_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ask(spark, sf_dir, "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer").withColumn(results.PLACE, F.col("c_custkey"))
    rows = [(p["key"], p["sample"], ",".join(p["samples"]), p["distinct_count"]) for p in classify.field_probe(df, classify.profiles(df))]
    return spark.createDataFrame(rows, "key string, sample string, samples string, distinct_count long")


def mask_of(column: str, alias: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = ask(spark, sf_dir, f"SELECT c_nationkey, c_name AS {column} FROM customer")
        return masked_frame(df, SALT).select("c_nationkey", F.col(column).alias(alias))

    return run


#: For each kind a column name that has it, and its token in DuckDB.
MASKS = {
    "email": ("email", "'user_' || lower({h10}) || '@example.invalid'"),
    "phone": ("telefono", "'+39' || translate({h10}, 'ABCDEF', '012345')"),
    "name": ("cognome", "'NAME_' || {h8}"),
    "org": ("ragione_sociale", "'ORG_' || {h8}"),
    "address": ("indirizzo", "'ADDRESS_' || {h8}"),
    "city": ("citta", "'CITY_' || {h8}"),
    "text": ("memo", "'TEXT_' || {h10}"),
}


def duck_digest(key: str, value: str, length: int) -> str:
    return f"upper(substr(sha256('{SALT}|{key}|' || {value}), 1, {length}))"


def masked_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masks of a whole table: kinds by name, and what a profile of the whole table says."""
    df = results.normalized(ask(spark, sf_dir, "SELECT * FROM events"))
    return masked_frame(df, SALT, known=classify.profiles(df))


def masked_read(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir, sql).read("prod-main", sql).frame


CUSTOMERS = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_custkey"
ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders ORDER BY o_orderkey"


def inline_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ask(spark, sf_dir, "SELECT doc_id, text FROM documents")
    return df.select("doc_id", F.sha2(masks.inline(SALT, F.col("text")), 256).alias("masked_sha256"))


# texts, policy, log and sessions


def key_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ask(spark, sf_dir, "SELECT concat('Customer', initcap(c_mktsegment), '--', c_name, '_') AS name FROM customer")
    return names.select("name", text.key_column(F.col("name")).alias("key"))


def sql_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ask(spark, sf_dir, "SELECT n_nationkey, concat('SELECT * FROM dbo.T', n_regionkey, ' a JOIN [Users] b ON 1=1 join dbo.t', n_regionkey, ' c') AS q FROM nation")
    return texts.select("n_nationkey", text.scope_column(F.col("q")).alias("scope"))


def sql_hash_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ask(spark, sf_dir, "SELECT c_custkey, concat('  SELECT *   FROM t ', repeat('x', 200), c_name) AS q FROM customer")
    return texts.select("c_custkey", text.sql_hash_column(F.col("q")).alias("hash"), text.sql_preview_column(F.col("q")).alias("preview"))


def targets_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry as a table, with a target for each customer."""
    tools = ", ".join(map(repr, TOOLS))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(
        "concat('T', c_custkey) AS target_id", "c_name AS display_name", "concat('e', c_custkey div 2) AS environment", "'spark' AS db_kind", "if(c_acctbal > 0, 'active', 'disabled') AS status",
        "concat('DB_', c_nationkey) AS connection_env_var", "c_nationkey % 3 <> 0 AS read_enabled", "c_nationkey % 4 = 0 AS write_enabled", "c_nationkey % 2 = 0 AS anonymization_enabled", "'off' AS anonymization_mode",
        "if(c_nationkey % 2 = 0, 'ollama', 'none') AS llm_provider", "'' AS llm_model", "100 AS max_rows", "1000 AS max_result_bytes", f"if(c_mktsegment = 'BUILDING', array('db_read'), array({tools})) AS allowed_tools",
        "named_struct('runtime_status', CASE c_custkey % 10 WHEN 0 THEN 'vault_locked' WHEN 1 THEN 'Ready ' END, 'last_synced_at', CAST(NULL AS STRING), 'last_error', CAST(NULL AS STRING)) AS state",
    )


#: targets_of() in the other engine's SQL.
TARGETS = f"""
    WITH targets AS (
        SELECT 'T' || c_custkey AS id, c_name AS display_name, 'e' || (c_custkey // 2) AS environment, CASE WHEN c_acctbal > 0 THEN 'active' ELSE 'disabled' END AS status, 'DB_' || c_nationkey AS connection,
               c_nationkey % 3 <> 0 AS can_read, c_nationkey % 4 = 0 AS can_write, c_nationkey % 2 = 0 AS anon, CASE WHEN c_nationkey % 2 = 0 THEN 'ollama' ELSE 'none' END AS provider,
               CASE WHEN c_mktsegment = 'BUILDING' THEN ['db_read'] ELSE {TOOLS!r} END AS tools, CASE c_custkey % 10 WHEN 0 THEN 'vault_locked' WHEN 1 THEN 'Ready ' END AS runtime FROM customer)
"""
BOUND = [f"DB_{k}" for k in range(14)]


def target_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.summary(targets_of(spark, sf_dir))


def policy_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.matrix(targets_of(spark, sf_dir))


def diag_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.routes(targets_of(spark, sf_dir))


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.readiness(targets_of(spark, sf_dir), BOUND)


def missing_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.missing_connections(targets_of(spark, sf_dir), {name: "x" for name in BOUND} | {"DB_14": ""})


def log_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT event_id, 'db_read' AS tool, concat('target-', user_id % 5) AS target_id, concat('SELECT ', value) AS sql, map('b', props, 'a', event_type) AS parameters, user_id AS max_rows FROM events"
    logged = ask(spark, sf_dir, sql)
    return audit.redacted_log(logged.drop("event_id"), "info")


def session_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.expiry(ask(spark, sf_dir, "SELECT user_id, ts FROM events"), 3600, "2024-01-30 20:00:00")


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.windows(ask(spark, sf_dir, "SELECT user_id, ts FROM events"), 3600)


def session_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of sessions over events, by what it said last of each; it stops after the files that are there."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    events = own.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    commands = events.select(F.col("user_id").cast("string").alias("session"), F.col("ts").cast("timestamp").alias("at"), F.lit("set").alias("op"), F.col("event_type").alias("value"), F.lit(3_600_000).cast("long").alias("ttl_ms"))
    path = storage.fresh_path(spark, "sessions")
    sessions.ttl_stream(commands).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    said = spark.read.parquet(f"{path}/out").groupBy(F.col("session").cast("long").alias("user_id")).agg(F.max(F.struct("last_seen", (~F.col("alive")).alias("over"), "ends_at")).alias("x"))
    now = F.lit("2024-01-30 20:00:00").cast("timestamp")
    return said.select("user_id", F.col("x.last_seen").cast("timestamp_ntz").alias("last_seen"), (F.col("x.ends_at") <= now).alias("expired"))


# joins, prefixes, sketches and recursion as DataFrame functions


def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events while an order is on its way, 8400 days after it was made and for some hours."""
    events = ask(spark, sf_dir, "SELECT event_id, ts FROM events")
    orders = ask(spark, sf_dir, "SELECT o_orderkey, o_orderdate + INTERVAL 8400 DAYS AS sent, o_orderdate + INTERVAL 8400 DAYS + make_interval(0, 0, 0, 0, 1 + o_orderkey % 12) AS came FROM orders")
    return range_join.interval_join(events, orders, "ts", "sent", "came").select("event_id", "o_orderkey")


def asof_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = ask(spark, sf_dir, "SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts FROM events")
    orders = ask(spark, sf_dir, "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate FROM orders")
    return asof.asof_join(events, orders, ("user_id", "o_custkey"), ("ts", "o_orderdate"), ["o_orderkey"]).select("event_id", "o_orderkey")


def asof_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the last purchase before it, of all users: one key, which slices of time split."""
    events = ask(spark, sf_dir, "SELECT event_id, 1 AS one, CAST(ts AS TIMESTAMP) AS ts FROM events")
    bought = ask(spark, sf_dir, "SELECT event_id AS bought, 1 AS same, CAST(ts AS TIMESTAMP) AS since FROM events WHERE event_type = 'purchase'")
    return asof.asof_join(events, bought, ("one", "same"), ("ts", "since"), ["bought"]).select("event_id", "bought")


def bytes_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first orders whose JSON fits into 200,000 bytes, of a sorted table of any size."""
    rows = results.normalized(ask(spark, sf_dir, "SELECT o_orderkey AS k, o_orderstatus, o_orderpriority FROM orders"))
    return prefixes.within_bytes(prefixes.placed(rows, F.col("k").cast("long")), 200_000).drop(results.PLACE)


def sketch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts sold by return flag: sketches by day, added in two parts, the second of which has days of the first again."""
    items = ask(spark, sf_dir, "SELECT l_returnflag, l_partkey, l_shipdate FROM lineitem")
    held = sketches.DailySketches(spark, storage.fresh_path(spark, "sketches"), "l_partkey", ["l_returnflag"])
    held.add(items.where("l_shipdate < '1998-01-01'"), "l_shipdate")
    held.add(items, "l_shipdate")
    exact = items.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("exact"))
    return held.counts().join(exact, "l_returnflag").select("l_returnflag", "exact", (F.abs(F.col("about") / F.col("exact") - 1) < 0.03).alias("close"))


def reach_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that dear orders lead to from nation 3, an order being a link from its customer to one that its key names."""
    links = ask(spark, sf_dir, "SELECT o_custkey AS a, o_orderkey * 7919 % (SELECT count(*) FROM customer) AS b FROM orders WHERE o_totalprice > 350000")
    start = ask(spark, sf_dir, "SELECT c_custkey AS node FROM customer WHERE c_nationkey = 3")
    return reach.reach(links, start)


# writes: the new version of the table, and how many rows the statement touches

WRITES = {
    "insert_append": ("INSERT INTO customer (c_custkey, c_name, c_nationkey) SELECT o_orderkey + 1000000, o_orderpriority, 7 FROM orders WHERE o_totalprice > 450000", "SELECT o_orderkey + 1000000 AS c_custkey, o_orderpriority AS c_name, 7 AS c_nationkey, NULL::DOUBLE AS c_acctbal, NULL::VARCHAR AS c_mktsegment FROM orders WHERE o_totalprice > 450000"),
    "cte_insert": (
        "WITH dear AS (SELECT o_orderkey AS k, o_orderpriority AS p FROM orders WHERE o_totalprice > 450000) INSERT INTO customer (c_custkey, c_name) SELECT k + 2000000, p FROM dear",
        "SELECT o_orderkey + 2000000 AS c_custkey, o_orderpriority AS c_name, NULL::INT AS c_nationkey, NULL::DOUBLE AS c_acctbal, NULL::VARCHAR AS c_mktsegment FROM orders WHERE o_totalprice > 450000",
    ),
    "cte_merge": (
        "WITH s AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey = 4) MERGE INTO customer AS t USING s ON t.c_custkey = s.k WHEN MATCHED THEN UPDATE SET c_mktsegment = 'FOUR'",
        "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_nationkey = 4 THEN 'FOUR' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    ),
    "update_cow": ("UPDATE customer SET c_mktsegment = 'VIP', c_acctbal = c_acctbal + 1 WHERE c_nationkey = @n", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey = 3 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey = 3 THEN 'VIP' ELSE c_mktsegment END AS c_mktsegment FROM customer"),
    "delete_cow": ("DELETE FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 100000", "SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 100000)"),
    "merge_cow": (
        "MERGE INTO customer AS t USING (SELECT c_custkey * 2 AS k, c_name AS name FROM customer) AS s ON t.c_custkey = s.k WHEN MATCHED AND t.c_nationkey = 5 THEN DELETE WHEN MATCHED THEN UPDATE SET c_name = s.name WHEN NOT MATCHED THEN INSERT (c_custkey, c_name) VALUES (s.k, s.name)",
        "SELECT t.c_custkey, coalesce(s.name, t.c_name) AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer t LEFT JOIN (SELECT c_custkey * 2 AS k, c_name AS name FROM customer) s ON t.c_custkey = s.k WHERE s.k IS NULL OR c_nationkey <> 5"
        " UNION ALL SELECT k, name, NULL, NULL, NULL FROM (SELECT c_custkey * 2 AS k, c_name AS name FROM customer) WHERE k NOT IN (SELECT c_custkey FROM customer)",
    ),
    # sources that repeat a key
    "merge_repeats_insert": (
        "MERGE INTO customer AS t USING orders AS s ON t.c_custkey = s.o_custkey + 1000 WHEN NOT MATCHED THEN INSERT (c_custkey, c_name) VALUES (s.o_custkey + 1000, s.o_orderpriority)",
        "SELECT * FROM customer UNION ALL SELECT o_custkey + 1000, o_orderpriority, NULL, NULL, NULL FROM orders WHERE o_custkey + 1000 NOT IN (SELECT c_custkey FROM customer)",
    ),
    "merge_repeats_update": (
        "MERGE INTO customer AS t USING (SELECT o_custkey AS k, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) AS s ON t.c_custkey = s.k WHEN MATCHED AND s.n = 2 THEN UPDATE SET c_name = CAST(s.o AS STRING)",
        "SELECT c_custkey, coalesce(o::VARCHAR, c_name) AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer LEFT JOIN (SELECT * FROM (SELECT o_custkey AS k, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 2) ON k = c_custkey",
    ),
    "merge_repeats_by_source": (
        "MERGE INTO customer AS t USING (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS s ON t.c_custkey = s.o_custkey WHEN NOT MATCHED BY SOURCE AND t.c_nationkey < 9 THEN DELETE WHEN NOT MATCHED BY SOURCE THEN UPDATE SET c_mktsegment = 'NONE'",
        "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN k THEN c_mktsegment ELSE 'NONE' END AS c_mktsegment FROM (SELECT *, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS k FROM customer) WHERE k OR c_nationkey >= 9",
    ),
}


#: Writes that return rows: what they return.
RETURNED = {
    "update_output": (
        "UPDATE customer SET c_acctbal = c_acctbal + 1, c_mktsegment = 'VIP' OUTPUT deleted.c_custkey, deleted.c_mktsegment AS was, inserted.c_mktsegment AS now, inserted.c_acctbal AS balance WHERE c_nationkey = 3",
        "SELECT c_custkey::VARCHAR AS c_custkey, c_mktsegment AS was, 'VIP' AS now, c_acctbal + 1 AS balance FROM customer WHERE c_nationkey = 3",
    ),
    "merge_output": (
        "MERGE INTO nation AS t USING (SELECT s_nationkey AS k, s_suppkey AS s, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier UNION ALL SELECT 100, 1, 1 UNION ALL SELECT 100, 2, 1) AS s ON t.n_nationkey = s.k"
        " WHEN MATCHED AND s.n = 1 AND s.k < 5 THEN DELETE WHEN MATCHED AND s.n = 1 THEN UPDATE SET n_name = CAST(s.s AS STRING) WHEN NOT MATCHED THEN INSERT (n_nationkey, n_name) VALUES (s.k, CAST(s.s AS STRING))"
        " OUTPUT $action, deleted.n_name AS was, inserted.n_name AS now, coalesce(inserted.n_nationkey, deleted.n_nationkey) AS k",
        "WITH s AS (SELECT s_nationkey AS k, min(s_suppkey) AS s FROM supplier GROUP BY 1) SELECT CASE WHEN k < 5 THEN 'DELETE' ELSE 'UPDATE' END AS \"$action\", n_name AS was, CASE WHEN k >= 5 THEN s::VARCHAR END AS now, k FROM s JOIN nation ON n_nationkey = k"
        " UNION ALL SELECT 'INSERT', NULL, x::VARCHAR, 100 FROM (VALUES (1), (2)) v(x)",
    ),
}


def returned_of(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, sql)
        wide = from_records([record("dev-main", "dev", write_enabled=True, max_result_bytes=2**31 - 1)])
        return Engine(spark, wide, e.tables, env=e.env, scratch=storage.fresh_path(spark, "written")).write("dev-main", sql).frame

    return run


def write_of(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir, sql).plan_write("dev-main", sql, {"n": 3}).rows


def rows_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("insert_append", "update_cow", "delete_cow", "merge_cow"):
        sql = WRITES[name][0]
        one = engine(spark, sf_dir, sql).plan_write("dev-main", sql, {"n": 3}).affected.withColumn("statement", F.lit(name))
        out = one if out is None else out.union(one)
    return out


#: White space as JavaScript has it, in the regular expressions of the other engine.
SPACES = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
INLINE = """
    WITH mails AS (SELECT doc_id, regexp_split_to_array(text, '{email}') AS p, regexp_extract_all(text, '{email}') AS f FROM documents)
    , plain AS (SELECT doc_id, p[1] || coalesce(array_to_string(list_transform(range(1, len(f) + 1), lambda i: 'user_' || lower({user}) || '@example.invalid' || p[i + 1]), ''), '') AS v FROM mails)
    , parts AS (SELECT doc_id, v, regexp_extract(v, '{signed}', 1) AS s FROM plain)
    , numbers AS (SELECT doc_id, v, s, regexp_split_to_array(s, '{number}') AS p, regexp_extract_all(s, '{number}') AS f FROM parts)
    SELECT doc_id, sha256(p[1] || coalesce(array_to_string(list_transform(range(1, len(f) + 1), lambda i: CASE WHEN i = len(f) AND p[i + 1] = '' AND regexp_full_match(f[i], '[0-9]+') THEN f[i]
        ELSE '+39' || translate({phone}, 'ABCDEF', '012345') END || p[i + 1]), ''), '') || substr(v, length(s) + 1)) AS masked_sha256 FROM numbers
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: lambda s, d, sql=sql: ask(s, d, sql) for name, (sql, _) in READS.items()}
    out |= {f"mask_{kind}": mask_of(column, "masked") for kind, (column, _) in MASKS.items()}
    out |= {name: write_of(sql) for name, (sql, _) in WRITES.items()}
    out |= {name: returned_of(sql) for name, (sql, _) in RETURNED.items()}
    out |= {"masked_read_customer": masked_read(CUSTOMERS), "masked_read_orders": masked_read(ORDERS), "masked_events": masked_all}
    for f in (
        approx_distinct, param_filter, row_cap, pre_limit_count, byte_budget, byte_clamp_masked, cell_normalize, column_metadata, column_profile, column_forms, field_probe, inline_mask,
        key_normalize, sql_sources, sql_hash_preview, target_summary, policy_matrix, diag_resolution, readiness, missing_connections, log_redaction, session_expiry, session_windows, session_ttl, rows_affected,
        interval_join, asof_sliced, asof_events, bytes_prefix, sketch_counts, reach_customers,
    ):
        out[f.__name__] = f
    return out


def oracles() -> dict[str, str]:
    out = {name: duck or sql for name, (sql, duck) in READS.items()}
    for kind, (column, token) in MASKS.items():
        key = text.key_of(column)
        out[f"mask_{kind}"] = f"SELECT c_nationkey, {token.format(h8=duck_digest(key, 'c_name', 8), h10=duck_digest(key, 'c_name', 10))} AS masked FROM customer"
    out |= {name: duck for name, (_, duck) in [*WRITES.items(), *RETURNED.items()]}
    iso = "strftime({}, '%Y-%m-%dT%H:%M:%S.%gZ')"
    sized = "SELECT *, row_number() OVER (ORDER BY id) AS rn, sum(b) OVER (ORDER BY id) AS total FROM (SELECT c_custkey AS id, {cols}, strlen(to_json({{{pack}}})) AS b FROM customer)"
    plain = "c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey, c_mktsegment"
    hidden = f"'TEXT_' || {duck_digest('c_custkey', 'c_custkey', 10)} AS c_custkey, 'NAME_' || {duck_digest('c_name', 'c_name', 8)} AS c_name, c_nationkey, 'TEXT_' || {duck_digest('c_mktsegment', 'c_mktsegment', 10)} AS c_mktsegment"

    def pack(columns: str) -> str:
        names = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
        parts = [x.strip() for x in re.split(r", (?='|c_)(?![^()]*\))", columns)]
        return ", ".join(f"{n}: {p.rpartition(' AS ')[0] or p}" for n, p in zip(names, parts))

    def prefix(columns: str, first: str) -> str:
        return f"SELECT c_custkey, c_name, c_nationkey, c_mktsegment, (total + rn + 1)::BIGINT AS result_bytes FROM ({sized.format(cols=columns, pack=pack(columns))}) WHERE rn <= 200 AND ({first})"

    out |= {
        "approx_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, true AS close FROM lineitem GROUP BY l_returnflag",
        "param_filter": "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000",
        "row_cap": "SELECT c_custkey::VARCHAR AS c_custkey, c_name FROM customer ORDER BY customer.c_custkey LIMIT 17",
        "pre_limit_count": "SELECT least(count(*), 200) AS row_count, count(*) AS total_rows, 200 AS max_rows, count(*) > 200 AS truncated FROM lineitem",
        "byte_budget": prefix(plain, "rn = 1 AND b <= 4096 OR rn > 1 AND total + rn + 1 <= 4096"),
        "byte_clamp_masked": prefix(hidden, "total + rn + 1 <= 4096"),
        "cell_normalize": f"SELECT event_id::VARCHAR AS event_id, {iso.format('ts')} AS ts, user_id::VARCHAR AS user_id, value, base64(event_type::BLOB) AS raw, event_id || ',' || user_id AS ids, user_id::VARCHAR AS pair_a, {iso.format('ts')} AS pair_at FROM events",
        "column_metadata": " UNION ALL ".join(f"SELECT '{c}' AS name, true AS nullable, '{kind}' AS type, count({c}) AS n_values FROM customer" for c, kind in (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string"))),
        "column_profile": " UNION ALL ".join(f"SELECT '{k}' AS key, count({c}) AS n_values, least(count(DISTINCT {c}), 16) AS n_distinct FROM events" for k, c in (("tipo", "event_type"), ("user_id", "user_id"), ("value", "value"))),
        "column_forms": "SELECT * FROM (VALUES ('hostile', true, false, false), ('quality', true, false, false), ('codice_ordine', false, true, false), ('stato', false, false, true)) t(key, flag_like, code_like, enum_like)",
        "field_probe": " UNION ALL ".join(
            f"SELECT '{c}' AS key, min_by({c}::VARCHAR, c_custkey) AS sample, array_to_string(list_sort(list(DISTINCT {c}::VARCHAR))[1:5], ',') AS samples, least(count(DISTINCT {c}), 16) AS distinct_count FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
        ),
        "masked_read_customer": f"SELECT 'TEXT_' || {duck_digest('c_custkey', 'c_custkey', 10)} AS c_custkey, 'NAME_' || {duck_digest('c_name', 'c_name', 8)} AS c_name, c_nationkey, c_acctbal, 'TEXT_' || {duck_digest('c_mktsegment', 'c_mktsegment', 10)} AS c_mktsegment FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 100)",
        "masked_read_orders": f"SELECT 'TEXT_' || {duck_digest('o_orderkey', 'o_orderkey', 10)} AS o_orderkey, 'TEXT_' || {duck_digest('o_custkey', 'o_custkey', 10)} AS o_custkey, o_totalprice, 'TEXT_' || {duck_digest('o_orderdate', iso.format('o_orderdate'), 10)} AS o_orderdate FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100)",
        "masked_events": f"SELECT 'TEXT_' || {duck_digest('event_id', 'event_id', 10)} AS event_id, {iso.format('ts')} AS ts, 'TEXT_' || {duck_digest('user_id', 'user_id', 10)} AS user_id, event_type, value, 'TEXT_' || {duck_digest('props', 'props', 10)} AS props FROM events",
        "inline_mask": INLINE.format(
            user=duck_digest("inline_email", "f[i]", 10), phone=duck_digest("inline_phone", "f[i]", 10), email=r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}",
            number=r"\+?[0-9][0-9" + SPACES + r"().-]{6,}[0-9]", signed="(?s)^(.*[+" + SPACES + "().-][0-9]*)",
        ),
        "key_normalize": "SELECT name, regexp_replace(regexp_replace(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key FROM (SELECT 'Customer' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || '--' || c_name || '_' AS name FROM customer)",
        "sql_sources": "SELECT n_nationkey, 'dbo.t' || n_regionkey || '|users' AS scope FROM nation",
        "sql_hash_preview": "SELECT c_custkey, substr(sha256(q), 1, 16) AS hash, substr(trim(regexp_replace(q, '\\s+', ' ', 'g')), 1, 160) AS preview FROM (SELECT c_custkey, '  SELECT *   FROM t ' || repeat('x', 200) || c_name AS q FROM customer)",
        "diag_resolution": TARGETS + "SELECT environment, CASE WHEN count(*) FILTER (status = 'active') = 1 THEN min(id) FILTER (status = 'active') END AS target_id, count(*) FILTER (status = 'active') AS candidates, coalesce(string_agg(id, ', ' ORDER BY id) FILTER (status = 'active'), '') AS candidate_ids FROM targets GROUP BY environment",
        "readiness": TARGETS + f"SELECT count(*) AS active_targets, count(*) FILTER (connection NOT IN ({str(BOUND)[1:-1]})) AS missing_connections, count(*) FILTER (runtime = 'vault_locked') AS blocked_targets, false AS ready FROM targets WHERE status = 'active'",
        "missing_connections": TARGETS + f"SELECT id AS target_id, connection AS connection_env_var FROM targets WHERE status = 'active' AND connection NOT IN ({str(BOUND)[1:-1]})",
        "session_ttl": "SELECT user_id, max(ts) AS last_seen, max(ts) + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-30 20:00:00' AS expired FROM events GROUP BY user_id",
        "interval_join": "SELECT event_id, o_orderkey FROM events JOIN orders ON ts >= o_orderdate + INTERVAL 8400 DAYS AND ts < o_orderdate + INTERVAL 8400 DAYS + to_hours(1 + o_orderkey % 12)",
        "asof_sliced": READS["join_asof"][1],
        "asof_events": "SELECT event_id, (SELECT max_by(b.event_id, (b.ts, b.event_id)) FROM events b WHERE b.event_type = 'purchase' AND b.ts <= e.ts) AS bought FROM events e",
        "bytes_prefix": "SELECT k, o_orderstatus, o_orderpriority, (total + rn + 1)::BIGINT AS result_bytes FROM (SELECT *, row_number() OVER w AS rn, sum(b) OVER w AS total FROM (SELECT o_orderkey, o_orderkey::VARCHAR AS k, o_orderstatus, o_orderpriority, strlen(to_json({k: o_orderkey::VARCHAR, o_orderstatus: o_orderstatus, o_orderpriority: o_orderpriority})) AS b FROM orders) WINDOW w AS (ORDER BY o_orderkey)) WHERE total + rn + 1 <= 200000",
        "sketch_counts": "SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, true AS close FROM lineitem GROUP BY l_returnflag",
        "reach_customers": "WITH RECURSIVE links AS (SELECT DISTINCT o_custkey AS a, o_orderkey * 7919 % (SELECT count(*) FROM customer) AS b FROM orders WHERE o_totalprice > 350000), r AS (SELECT c_custkey AS node, 0 AS hops FROM customer WHERE c_nationkey = 3 UNION SELECT b, hops + 1 FROM r JOIN links ON a = node WHERE hops < 40) SELECT node, min(hops) AS hops FROM r GROUP BY node",
        "log_redaction": "SELECT 'db_read' AS tool, 'target-' || (user_id % 5) AS target_id, substr(sha256('SELECT ' || value), 1, 16) AS sql_hash, NULL::VARCHAR AS sql_preview, 2 AS parameter_count, 'a,b' AS parameter_keys, user_id AS max_rows FROM events",
        "session_expiry": "SELECT user_id, max(ts) AS last_seen, count(*) AS n_events, max(ts) + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-30 20:00:00' AS expired FROM events GROUP BY user_id",
        "session_windows": "SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 1 HOUR AS ended, count(*) AS n_events FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s",
        "rows_affected": "SELECT count(*) AS rows_affected, 'insert_append' AS statement FROM orders WHERE o_totalprice > 450000 UNION ALL SELECT count(*), 'update_cow' FROM customer WHERE c_nationkey = 3 UNION ALL SELECT count(*), 'delete_cow' FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 100000 UNION ALL SELECT count(*), 'merge_cow' FROM customer",
        "target_summary": TARGETS + "SELECT id AS target_id, display_name, environment, 'spark' AS db_kind, status, runtime AS runtime_status, can_read AS read_enabled, can_write AS write_enabled, anon AS anonymization_enabled, provider AS llm_provider, '' AS llm_model FROM targets",
    }
    # the matrix from the rules, as SQL over the registry's rows
    out["policy_matrix"] = f"""{TARGETS}
        , reasons AS (
            SELECT id, tool, anon, CASE WHEN status <> 'active' THEN 'Target "' || id || '" is disabled.'
                WHEN NOT list_contains(tools, tool) THEN 'Tool "' || tool || '" is not allowed for target "' || id || '".'
                WHEN tool = 'db_read' AND NOT can_read THEN 'Read access is disabled for target "' || id || '".'
                WHEN tool = 'db_write' AND NOT can_write THEN 'Write access is disabled for target "' || id || '".' END AS reason
            FROM targets, (SELECT unnest({TOOLS!r}) AS tool))
        SELECT id AS target_id, tool AS tool_name, reason IS NULL AS allowed, reason IS NULL AND tool = 'db_read' AND anon AS anonymization_required, reason AS denial_reason FROM reasons
    """
    return out
