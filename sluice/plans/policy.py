"""Who may do what on which target: as a function of one target, and as one expression over a table of them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sources.registry import Registry, Target

TOOLS = ("db_target_info", "db_policy_info", "db_read", "db_write")


def decide(target: Target | None, tool: str | None) -> dict[str, Any]:
    """{tool_name, allowed, anonymization_required, denial_reason}; without a tool there is nothing to decide."""
    if target is None:
        reason = "Unknown target_id."
    elif not tool:
        return {"tool_name": None, "allowed": None, "anonymization_required": None, "denial_reason": None}
    elif tool not in TOOLS:
        reason = f"Unknown tool_name: {tool}"
    elif not target.active:
        reason = f'Target "{target.target_id}" is disabled.'
    elif tool not in target.allowed_tools:
        reason = f'Tool "{tool}" is not allowed for target "{target.target_id}".'
    elif tool == "db_read" and not target.read_enabled:
        reason = f'Read access is disabled for target "{target.target_id}".'
    elif tool == "db_write" and not target.write_enabled:
        reason = f'Write access is disabled for target "{target.target_id}".'
    else:
        return {"tool_name": tool, "allowed": True, "anonymization_required": tool == "db_read" and target.anonymization_enabled, "denial_reason": None}
    return {"tool_name": tool or None, "allowed": False, "anonymization_required": False, "denial_reason": reason}


def overview(target: Target, tool: str | None = None) -> dict[str, Any]:
    """decide() for a tool; without one, for all tools under available_policies."""
    return {"target_id": target.target_id, **decide(target, tool), "available_policies": [] if tool else [decide(target, t) for t in TOOLS]}


def denial(tool: Column) -> Column:
    """Over the registry's table: the reason against a tool; null if it is allowed."""
    name = F.col("target_id")
    return (
        F.when(~tool.isin(*TOOLS), F.concat(F.lit("Unknown tool_name: "), tool))
        .when(F.col("status") != "active", F.concat(F.lit('Target "'), name, F.lit('" is disabled.')))
        .when(~F.array_contains("allowed_tools", tool), F.concat(F.lit('Tool "'), tool, F.lit('" is not allowed for target "'), name, F.lit('".')))
        .when((tool == "db_read") & ~F.col("read_enabled"), F.concat(F.lit('Read access is disabled for target "'), name, F.lit('".')))
        .when((tool == "db_write") & ~F.col("write_enabled"), F.concat(F.lit('Write access is disabled for target "'), name, F.lit('".')))
    )


def matrix(targets: DataFrame) -> DataFrame:
    """decide() of every target and tool: the tools are unfolded beside each target, four rows each."""
    each = targets.withColumn("tool_name", F.explode(F.array(*map(F.lit, TOOLS))))
    each = each.withColumn("denial_reason", denial(F.col("tool_name"))).withColumn("allowed", F.col("denial_reason").isNull())
    return each.select("target_id", "tool_name", "allowed", (F.col("allowed") & (F.col("tool_name") == "db_read") & F.col("anonymization_enabled")).alias("anonymization_required"), "denial_reason")


def summary(targets: DataFrame) -> DataFrame:
    """What may be shown of targets: nothing about their connections."""
    return targets.select(
        "target_id", "display_name", "environment", "db_kind", "status", F.col("state.runtime_status").alias("runtime_status"),
        "read_enabled", "write_enabled", "anonymization_enabled", "llm_provider", "llm_model",
    )


def summary_of(target: Target) -> dict[str, Any]:
    names = ("target_id", "display_name", "environment", "db_kind", "status", "runtime_status", "read_enabled", "write_enabled", "anonymization_enabled", "llm_provider", "llm_model")
    return {n: getattr(target, n) for n in names}


def info_of(target: Target) -> dict[str, Any]:
    limits = {"max_rows": target.max_rows, "max_result_bytes": target.max_result_bytes}
    return {**summary_of(target), "allowed_tools": list(target.allowed_tools), "anonymization_mode": target.anonymization_mode, "effective_limits": limits}


def runtime_blocker(target: Target) -> str | None:
    """Why the target's state forbids queries; null if it is unset or ready."""
    status = (target.runtime_status or "").strip()
    if status.lower() in ("", "ready"):
        return None
    error = (target.state or {}).get("last_error")
    return f'Target "{target.target_id}" is not ready: {status}' + (f" ({error})" if error else "")


def readiness(targets: DataFrame, bound: Iterable[str]) -> DataFrame:
    """One row: whether there are active targets, all with their connection bound and in a ready state."""
    spark: SparkSession = targets.sparkSession
    names = spark.createDataFrame([(n,) for n in sorted(set(bound))], "connection_env_var string")
    status = F.lower(F.trim(F.coalesce(F.col("state.runtime_status"), F.lit(""))))
    active = targets.where("status = 'active'").join(F.broadcast(names.withColumn("bound", F.lit(True))), "connection_env_var", "left")
    counts = active.agg(
        F.count("*").alias("active_targets"),
        F.count_if(F.col("bound").isNull()).alias("missing_connections"),
        F.count_if(~status.isin("", "ready")).alias("blocked_targets"),
    )
    return counts.withColumn("ready", (F.col("active_targets") > 0) & (F.col("missing_connections") == 0) & (F.col("blocked_targets") == 0))


def route(registry: Registry, environment: str, target_id: str | None = None) -> tuple[Target | None, list[str]]:
    """The target of a diagnostic query, or what stands against it."""
    if target_id:
        target = registry.get(target_id)
        if target is None:
            return None, [f'Unknown target_id "{target_id}" for diagnostic query.']
        if not target.active:
            return None, [f'Target "{target_id}" is not active and cannot be used for diagnostic query.']
        if target.environment != environment:
            return None, [f'Target "{target_id}" belongs to environment "{target.environment}", not "{environment}".']
        return target, []
    found = [t for t in registry.list() if t.environment == environment and t.active]
    if len(found) == 1:
        return found[0], []
    if not found:
        return None, [f'No active target found for database_target "{environment}".']
    names = ", ".join(sorted(t.target_id for t in found))
    return None, [f'Multiple active targets matched database_target "{environment}": {names}. Name one by target_id.']


def routes(targets: DataFrame) -> DataFrame:
    """route() without target_id for every environment that the table has: the one active target, or the ids among which it is unclear."""
    active = F.when(F.col("status") == "active", F.col("target_id"))
    found = targets.groupBy("environment").agg(F.array_sort(F.collect_set(active)).alias("ids"))
    return found.select("environment", F.when(F.size("ids") == 1, F.get("ids", F.lit(0))).alias("target_id"), F.size("ids").cast("long").alias("candidates"), F.array_join("ids", ", ").alias("candidate_ids"))


def missing_connections(targets: DataFrame, env: Mapping[str, str]) -> DataFrame:
    """(target_id, connection_env_var) of active targets whose connection isn't bound."""
    names = targets.sparkSession.createDataFrame([(k,) for k, v in env.items() if v], "connection_env_var string")
    return targets.where("status = 'active'").join(F.broadcast(names), "connection_env_var", "left_anti").select("target_id", "connection_env_var")
