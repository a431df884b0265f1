import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.plans import dialect, guard

READS = [
    "SELECT id, name FROM dbo.Users",
    "WITH x AS (SELECT TOP 10 id FROM t) SELECT * FROM x",
    ";WITH x AS (SELECT 1 AS a) SELECT a FROM x;",
    "SELECT 'DROP TABLE t' AS s -- EXEC\n FROM t",
    "SELECT [EXEC], [INTO] FROM t",
    'SELECT "UPDATE", "DELETE" FROM t',
    "SELECT a /* INSERT; */ FROM t",
    "SELECT '--' AS a, b FROM t",
]
NOT_READS = [
    ("UPDATE t SET a = 1", "Only SELECT"),
    ("SELECT * INTO #tmp FROM t", "INTO"),
    ("SELECT 1; SELECT 2", "Multiple"),
    ("SELECT 1; -- c\nDELETE FROM t", "Multiple"),
    ("SELECT '--'; DELETE FROM t", "Multiple"),
    ("SELECT '/*'; DELETE FROM t; SELECT '*/'", "Multiple"),
    ("WITH x AS (SELECT 1) INSERT INTO t SELECT 1", "INSERT"),
    ("", "required"),
    (None, "required"),
    ("   ", "required"),
    ("SELECTED x", "Only SELECT"),
]
WRITES = ["UPDATE dbo.Users SET a = 'OPEN' WHERE id = 1", "UPDATE t SET [EXEC] = 'DROP TABLE'", "UPDATE t SET \"ALTER\" = 'CREATE TABLE'", "WITH x AS (SELECT 1 AS a) INSERT INTO t SELECT a FROM x"]
NOT_WRITES = ["DROP TABLE t", "EXEC p", "UPDATE t SET a = 1; DELETE FROM t", "WITH x AS (SELECT 1) SELECT * INTO #tmp FROM x", "INSERT INTO t SELECT INTO x", "SELECT 1"]


@pytest.mark.parametrize("sql", READS)
def test_reads_pass(sql):
    assert guard.reason_against(sql) is None
    assert guard.checked(f"  {sql} ") == sql.strip()


@pytest.mark.parametrize("sql,reason", NOT_READS)
def test_others_do_not(sql, reason):
    assert reason in guard.reason_against(sql)
    with pytest.raises(guard.GuardError):
        guard.checked(sql)


def test_writes():
    assert [guard.reason_against(s, write=True) for s in WRITES] == [None] * len(WRITES)
    assert all(guard.reason_against(s, write=True) for s in NOT_WRITES)


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT TRANSFORM(a) USING 'cat' AS (b) FROM t",
        "SELECT reflect('java.lang.System', 'exit', 0)",
        "WITH q AS (SELECT TRANSFORM(a) USING 'cat' AS (b) FROM t) SELECT * FROM q",
        "SELECT a FROM t WHERE a IN (SELECT java_method('x', 'y'))",
        "SELECT a FROM t WHERE EXISTS (SELECT try_reflect('x', 'y') FROM u)",
        "SELECT a FROM (",
    ],
)
def test_plans_that_do_more_than_read(spark, sql):
    with pytest.raises(guard.GuardError):
        guard.inspect_read(spark, sql)


@pytest.mark.parametrize("sql", ["CREATE TABLE t (a INT)", "SET x = 1", "INSERT INTO t SELECT TRANSFORM(a) USING 'cat' AS (b) FROM u", "EXPLAIN SELECT 1"])
def test_plans_that_are_no_write(spark, sql):
    with pytest.raises(guard.GuardError):
        guard.inspect_write(spark, sql)


def test_dialect():
    say = dialect.translate
    assert say("SELECT TOP 3 [a b] FROM [dbo].[t];") == "SELECT `a b` FROM `t` LIMIT 3"
    assert say("SELECT a FROM dbo.t WHERE x = @p AND y = '@p dbo.t'", {"p": 1}) == "SELECT a FROM t WHERE x = :p AND y = '@p dbo.t'"
    assert say("SELECT a FROM t ORDER BY a OFFSET 2 ROWS FETCH NEXT 5 ROWS ONLY").endswith("LIMIT 5 OFFSET 2")
    assert say("SELECT ISNULL(a, 'ISNULL(') FROM t") == "SELECT coalesce(a, 'ISNULL(') FROM t"
    assert dialect.with_literals("UPDATE t SET a = @p, b = ':p'", {"p": "it's"}) == "UPDATE t SET a = 'it\\'s', b = ':p'"
    with pytest.raises(guard.GuardError, match="Invalid SQL parameter name: a b"):
        say("SELECT 1", {"a b": 1})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["SELECT ", "a", "'", "''", "--", "\n", "/*", "*/", ";", "DELETE FROM t", "[", "]", '"', " "]), max_size=12))
def test_no_statement_hides_behind_an_accepted_one(parts):
    """Where the guard lets a text pass, what a scanner that knows literals and comments sees has no second statement."""
    sql = "SELECT " + "".join(parts)
    if guard.reason_against(sql) is None:
        assert ";" not in guard.bare(sql).removesuffix(";") and "DELETE" not in guard.bare(sql).upper().split()
