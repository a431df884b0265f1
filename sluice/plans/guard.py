"""Which SQL text may run: by its words first, then by the plan that Spark's own parser makes of it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

#: Words that a read, and a write, may not hold outside literals, comments and quoted names.
READ_FORBIDS = ("INSERT", "UPDATE", "DELETE", "MERGE", "DROP", "ALTER", "TRUNCATE", "CREATE", "EXEC", "EXECUTE", "INTO")
WRITE_FORBIDS = ("DROP", "ALTER", "TRUNCATE", "CREATE", "EXEC", "EXECUTE")
WRITES = ("INSERT", "UPDATE", "DELETE", "MERGE")

#: Functions that run code of the host.
HOST_FUNCTIONS = {"reflect", "java_method", "try_reflect"}
#: Plan nodes of a statement that only reads.
READ_NODES = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Intersect", "Except", "Join", "LateralJoin",
    "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedRelation", "UnresolvedWith", "UnresolvedHaving", "UnresolvedInlineTable",
    "OneRowRelation", "WithWindowDefinition", "Generate", "Pivot", "Unpivot", "UnpivotTransformer", "UnresolvedPivot", "UnresolvedTableValuedFunction",
    "Sample", "Window", "LocalRelation", "Range", "UnresolvedOrderByAll", "UnresolvedIdentifier", "PlanWithUnresolvedIdentifier",
}
WRITE_NODES = {"InsertIntoStatement", "UpdateTable", "DeleteFromTable", "MergeIntoTable"}

# one pass over the text: whichever of these begins first counts, so a comment sign in a literal opens no comment
PARTS = re.compile(r"(?P<comment>/\*.*?(?:\*/|\Z)|--[^\n]*)|(?P<text>'(?:''|\\.|[^'\\])*')|(?P<name>\[(?:[^\]]|\]\])+\]|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`)", re.S)


class GuardError(ValueError):
    """The text may not run; the message says why."""


def bare(sql: str) -> str:
    """The text with comments gone, and literals and quoted names emptied; white space is single, a leading ; dropped."""
    stand_in = {"comment": " ", "text": "''", "name": '""'}
    text = PARTS.sub(lambda m: stand_in[m.lastgroup], sql)
    return re.sub(r"\s+", " ", text).strip().removeprefix(";").lstrip()


def reason_against(sql: Any, write: bool = False) -> str | None:
    """Why the words of the text forbid it; None if they don't. The reasons are fixed values, as texts that callers match."""
    if not isinstance(sql, str) or not sql.strip():
        return "SQL text is required."
    text = bare(sql).upper()
    words = re.findall(r"[A-Z_0-9@#$]+", text)
    first = re.match(r"\w*", text)[0]
    if first not in ((*WRITES, "WITH") if write else ("SELECT", "WITH")):
        return "Only INSERT, UPDATE, DELETE, MERGE, or write CTE statements are allowed." if write else "Only SELECT statements or read-only CTEs are allowed."
    if ";" in text.removesuffix(";"):
        return "Multiple SQL statements are not allowed."
    for word in WRITE_FORBIDS if write else READ_FORBIDS:
        if word in words:
            return f"Forbidden SQL keyword detected: {word}."
    if write and "SELECT INTO" in " ".join(words):
        return "SELECT INTO is not allowed."
    if first == "WITH" and write and not set(WRITES) & set(words):
        return "Write CTEs must resolve to INSERT, UPDATE, DELETE, or MERGE."
    if first == "WITH" and not write and "SELECT" not in words:
        return "Only read-only CTEs that resolve to SELECT are allowed."
    return None


def checked(sql: Any, write: bool = False) -> str:
    """The text itself, trimmed, if its words allow it."""
    if reason := reason_against(sql, write):
        raise GuardError(reason)
    return sql.strip()


def parsed(spark: SparkSession, sql: str) -> JavaObject:
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except (PySparkException, Py4JJavaError) as error:
        raise GuardError(f"The SQL can't be parsed: {str(error).splitlines()[0]}") from error


def _items(seq: JavaObject) -> Iterator[JavaObject]:
    at = seq.iterator()
    while at.hasNext():
        yield at.next()


def _expressions(node: JavaObject) -> Iterator[JavaObject]:
    waiting = list(_items(node.expressions()))
    while waiting:
        e = waiting.pop()
        yield e
        waiting += _items(e.children())


def plan_nodes(plan: JavaObject) -> Iterator[tuple[str, JavaObject]]:
    """(name, node) of a plan and all below it: children, the bodies of CTEs, and subqueries; and its functions, as
    ``name()``."""
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        name = node.getClass().getSimpleName()
        yield name, node
        waiting += _items(node.children())
        if name == "UnresolvedWith":
            waiting += [pair._2() for pair in _items(node.cteRelations())]
        else:
            waiting += [x for x in _items(node.innerChildren()) if hasattr(x, "expressions") and "logical" in x.getClass().getName()]
        for e in _expressions(node):
            kind = e.getClass().getSimpleName()
            if kind == "UnresolvedFunction":
                yield ".".join(_items(e.nameParts())).lower() + "()", e
            elif kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "InSubquery", "FunctionTableSubqueryArgumentExpression"):
                if kind != "InSubquery":
                    waiting.append(e.plan())


def inspect_read(spark: SparkSession, sql: str) -> None:
    """Raises unless the text parses to a statement that only reads tables by name."""
    for name, node in plan_nodes(parsed(spark, sql)):
        if name.endswith("()"):
            if name[:-2].split(".")[-1] in HOST_FUNCTIONS:
                raise GuardError(f"Forbidden function: {name[:-2]}.")
        elif name.rstrip("$") not in READ_NODES:
            raise GuardError(f"Only reads are allowed; the statement has {name}.")


def inspect_write(spark: SparkSession, sql: str) -> JavaObject:
    """The plan of a text that is one INSERT, UPDATE, DELETE or MERGE, whose sources only read."""
    plan = parsed(spark, sql)
    found = None
    for name, node in plan_nodes(plan):
        if name.endswith("()"):
            if name[:-2].split(".")[-1] in HOST_FUNCTIONS:
                raise GuardError(f"Forbidden function: {name[:-2]}.")
        elif name in WRITE_NODES and found is None:
            found = node
        elif name not in READ_NODES:
            raise GuardError(f"Only INSERT, UPDATE, DELETE and MERGE are allowed; the statement has {name}.")
    if found is None:
        raise GuardError("Write CTEs must resolve to INSERT, UPDATE, DELETE, or MERGE.")
    return found
