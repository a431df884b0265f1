"""Events of requests, with what they may say: never values or rows, SQL only as a hash and, when debugging, a preview."""

from __future__ import annotations

import contextvars
import json
import sys
from collections.abc import Mapping
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.text import sql_hash, sql_hash_column, sql_preview, sql_preview_column

LEVELS = {"error": 0, "info": 1, "debug": 2}
INFO_EVENTS = ("query_out", "query_failed")
DB_EVENTS = ("query_in", "db_driver_start", "db_driver_done", "anonymizer_start", "anonymizer_done", "query_out", "query_failed")
OUT = ("tool", "target_id", "row_count", "rows_affected", "truncated", "anonymization_applied", "anonymization_provider", "anonymization_mode")
STEP = ("tool", "target_id", "runtime_status", "provider", "mode", "row_count", "rows_affected", "truncated", "duration_ms", "error")

request: contextvars.ContextVar[dict[str, str]] = contextvars.ContextVar("request", default={})


def shown(event: str, level: str) -> bool:
    if event not in DB_EVENTS:
        return True
    return level == "debug" or level == "info" and event in INFO_EVENTS


def redacted(event: str, payload: Mapping[str, Any], level: str) -> dict[str, Any]:
    if event == "query_in":
        keys = sorted(payload.get("parameters") or {})
        sql = payload.get("sql")
        own = {"tool": payload.get("tool"), "target_id": payload.get("target_id"), "sql_hash": sql_hash(sql), "sql_preview": sql_preview(sql) if level == "debug" else None}
        return own | {"parameter_count": len(keys), "parameter_keys": keys, "max_rows": payload.get("max_rows")}
    if event in DB_EVENTS:
        return {k: payload.get(k) for k in (OUT if event == "query_out" else STEP)}
    return dict(payload)


class Audit:
    """Writes events as lines, errors to stderr and the rest to stdout, and keeps those of this process for tests."""

    def __init__(self, level: str = "info", form: str = "json", silent: bool = False):
        self.level, self.form, self.silent, self.events = level, form, silent, []

    def emit(self, event: str, payload: Mapping[str, Any], severity: str = "info") -> None:
        if not shown(event, self.level) or LEVELS[severity] > LEVELS[self.level]:
            return
        entry = {"timestamp": datetime.now(timezone.utc).isoformat(timespec="milliseconds"), "level": severity, "event": event, "payload": redacted(event, payload, self.level), **request.get()}
        self.events = [*self.events[-999:], entry]
        if not self.silent:
            line = json.dumps(entry, default=str) if self.form == "json" else f"{entry['timestamp']} {severity.upper()} {event} {json.dumps(entry['payload'], default=str)}"
            print(line, file=sys.stderr if severity == "error" else sys.stdout)


def table(spark: SparkSession, events: list[dict[str, Any]]) -> DataFrame:
    """Events as rows (timestamp, level, event, payload as JSON, request_id, session_id), to append to a log's Parquet."""
    rows = [(e["timestamp"], e["level"], e["event"], json.dumps(e["payload"], default=str), e.get("request_id"), e.get("session_id")) for e in events]
    return spark.createDataFrame(rows, "timestamp string, level string, event string, payload string, request_id string, session_id string")


def redacted_log(events: DataFrame, level: str = "info") -> DataFrame:
    """query_in events (tool, target_id, sql, parameters map, max_rows) as redacted() shows them."""
    keys = F.array_sort(F.map_keys("parameters"))
    preview = sql_preview_column(F.col("sql")) if level == "debug" else F.lit(None).cast("string")
    return events.select("tool", "target_id", sql_hash_column(F.col("sql")).alias("sql_hash"), preview.alias("sql_preview"), F.coalesce(F.size(keys), F.lit(0)).alias("parameter_count"), F.array_join(keys, ",").alias("parameter_keys"), "max_rows")
