"""The engine: targets, and the seven tools by which callers read, write and inspect them."""

from __future__ import annotations

import os
import re
import time
import uuid
from collections import deque
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice import storage
from sluice.functions.text import metadata_value
from sluice.operators import classify, prefixes, results, writes
from sluice.operators.audit import Audit
from sluice.operators.mask import masked_frame
from sluice.plans import dialect, guard, policy
from sluice.sources.registry import Registry, Target
from sluice.sources.settings import Settings

#: Results of reads that stay persisted.
KEPT = 16
#: Settings of a caller's session that a target's session takes over.
INHERITED = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold")


class ToolError(RuntimeError):
    """A tool's refusal or failure: code, message and details."""

    def __init__(self, code: str, message: str, **details: Any):
        super().__init__(message)
        self.code, self.details = code, details

    def envelope(self) -> dict[str, Any]:
        return {"error": {"code": self.code, "message": str(self), "details": self.details}}


@dataclass
class Result:
    """A bounded result: its rows as a DataFrame and what is known about them. columns are those of the source."""

    frame: DataFrame
    columns: list[dict[str, Any]]
    row_count: int
    result_bytes: int
    max_result_bytes_applied: int
    truncated: bool
    duration_ms: int
    total_rows_before_limits: int | None = None
    max_rows_applied: int | None = None
    rows_affected: int | None = None
    anonymization_applied: bool = False
    anonymization_provider: str = "none"
    anonymization_mode: str = "off"
    sql: str = ""
    extra: dict[str, Any] = field(default_factory=dict)

    @property
    def rows(self) -> list[dict[str, Any]]:
        """The rows, at most as many as the target's limits let through."""
        return [r.asDict(recursive=True) for r in self.frame.collect()]


class Engine:
    """tables: for each target the paths of its Parquet tables, or DataFrames. Each target has a session of its own,
    in which they are views; classifier: asked for the kinds of columns, see operators/classify.py; scratch: the folder of
    written tables' versions: engines that are given the same one, later processes too, see what was written, each
    statement what was written before it began. Without it they are below the warehouse, which on a cluster must be set
    to a folder that all machines share, in a folder of this engine's own that close() deletes."""

    def __init__(self, spark: SparkSession, registry: Registry, tables: Mapping[str, Mapping[str, str | DataFrame]], env: Mapping[str, str] | None = None, classifier: classify.Classifier | None = None, audit: Audit | None = None, scratch: str | None = None):
        self.spark, self.registry, self.tables = spark, registry, tables
        self.env = dict(os.environ if env is None else env)
        self.settings = Settings.read(self.env)
        self.classifier, self.cache = classifier, classify.KindCache()
        self.audit = audit or Audit(self.settings.log_level, self.settings.log_format, silent=True)
        self.scratch = scratch
        self._sessions: dict[str, tuple[SparkSession, writes.Store]] = {}
        self._kept: deque[DataFrame] = deque()

    # what callers may know

    def tool_info(self) -> dict[str, Any]:
        return {
            "server": "sluice",
            "purpose": "Governed SQL over named targets: policy, guards, limits and masking.",
            "tool_map": {"discovery": ["db_tool_info", "db_target_list", "db_target_info", "db_policy_info"], "read": ["db_read", "run_diagnostic_query"], "write": ["db_write"]},
        }

    def targets(self) -> list[dict[str, Any]]:
        return [policy.summary_of(t) for t in self.registry.list()]

    def target_info(self, target_id: str) -> dict[str, Any]:
        target = self._target(target_id)
        if not target.active:
            raise ToolError("target_disabled", f'Target "{target_id}" is disabled.', target_id=target_id, status=target.status)
        return policy.info_of(target)

    def policy(self, target_id: str, tool: str | None = None) -> dict[str, Any]:
        return policy.overview(self._target(target_id), tool)

    def readiness(self) -> DataFrame:
        return policy.readiness(self.registry.frame(self.spark), [k for k, v in self.env.items() if v])

    # sessions

    def _target(self, target_id: str) -> Target:
        target = self.registry.get(target_id)
        if target is None:
            raise ToolError("target_not_found", f"Unknown target_id: {target_id}", target_id=target_id)
        return target

    def session(self, target: Target) -> SparkSession:
        if target.target_id not in self._sessions:
            own = self.spark.newSession()
            for name in INHERITED:
                own.conf.set(name, self.spark.conf.get(name))
            own.conf.set("spark.sql.runSQLOnFiles", "false")  # a table is only what the target names
            own.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # rows grow with the tables; the limit of 100 levels stays, as T-SQL has it
            store = writes.Store(own, f"{self.scratch.rstrip('/')}/{target.target_id}" if self.scratch else "")
            for name, table in self.tables.get(target.target_id, {}).items():
                if isinstance(table, str):
                    store.open(name, table)
                else:
                    writes.frame(own, table._jdf.queryExecution().logical()).createOrReplaceTempView(name)
            self._sessions[target.target_id] = own, store
        return self._sessions[target.target_id][0]

    def _refresh(self, target: Target, sql: str) -> None:
        """Shows the newest versions of the tables that a statement names."""
        self.session(target)
        for name, table in self.tables.get(target.target_id, {}).items():
            if isinstance(table, str) and re.search(rf"(?i)(?<!\w){re.escape(name)}(?!\w)", sql):
                self._sessions[target.target_id][1].refresh(name)

    def _kinds(self, target: Target, sql: str) -> dict[str, str | None]:
        """What the columns of the tables that a statement names are, for dialect.spelled(); and its parameters."""
        known: dict[str, set[str]] = {}
        for name in self.tables.get(target.target_id, {}):
            if re.search(rf"(?i)(?<!\w){re.escape(name)}(?!\w)", sql):
                for f in self.session(target).table(name).schema.fields:
                    known.setdefault(f.name.lower(), set()).add("text" if isinstance(f.dataType, T.StringType) else "int" if isinstance(f.dataType, T.IntegralType) else "number" if isinstance(f.dataType, T.NumericType) else "other")
        return {name: min(kinds) if len(kinds) == 1 else None for name, kinds in known.items()}

    def _store(self, target: Target) -> writes.Store:
        own, store = self.session(target), self._sessions[target.target_id][1]
        if not store.folder:
            if not storage.on_one_machine(own) and not own.sparkContext.getConf().contains("spark.sql.warehouse.dir"):
                raise RuntimeError("Set spark.sql.warehouse.dir, or the engine's scratch, to a folder that the driver and all executors share.")
            store.folder = f"{own.conf.get('spark.sql.warehouse.dir').rstrip('/')}/sluice-{uuid.uuid4().hex}"
        return store

    def close(self) -> None:
        """Lets go of the targets' sessions, the results kept for them, and tables that were written for this engine alone."""
        for own, store in self._sessions.values():
            for view in own.catalog.listTables():
                own.catalog.dropTempView(view.name)
            if store.folder and not self.scratch:
                files, path = storage.files(own, store.folder)
                files.delete(path, True)
        for frame in self._kept:
            frame.unpersist()
        self._kept.clear()
        self._sessions.clear()

    def _admit(self, target_id: str, tool: str, sql: Any) -> tuple[Target, str]:
        target = self._target(target_id)
        decision = policy.decide(target, tool)
        if not decision["allowed"]:
            raise ToolError("policy_denied", decision["denial_reason"], target_id=target_id, tool_name=tool)
        try:
            return target, guard.checked(sql, write=tool == "db_write")
        except guard.GuardError as error:
            raise ToolError("invalid_sql", str(error), target_id=target_id) from error

    def _ready(self, target: Target, code: str) -> None:
        blocker = policy.runtime_blocker(target)
        if not blocker and not self.env.get(target.connection_env_var):
            blocker = f'Missing runtime environment variable "{target.connection_env_var}" for target "{target.target_id}".'
        if blocker:
            raise ToolError(code, blocker, target_id=target.target_id)

    # reads

    def query(self, target_id: str, sql: str, parameters: dict[str, Any] | None = None) -> DataFrame:
        """The whole answer of a guarded read as a DataFrame, lazily: for jobs within the cluster, where limits and
        masks come later. Policy, guard and state are those of db_read; nothing runs yet."""
        target, text = self._admit(target_id, "db_read", sql)
        self._ready(target, "db_read_failed")
        own = self.session(target)
        self._refresh(target, text)
        try:
            spelled = dialect.spelled(text, parameters, self._kinds(target, text))
            guard.inspect_read(own, spelled.text)
            answer = own.sql(spelled.text, args=parameters or {})
            if spelled.percent is None:
                return answer
            keys = [F.desc(k) if down else F.asc(k) for k, down in zip(spelled.keys, spelled.down)]
            return prefixes.top_percent(answer, spelled.percent, keys, spelled.ties, spelled.keys).drop(*spelled.keys)
        except guard.GuardError as error:
            raise ToolError("invalid_sql", str(error), target_id=target_id) from error
        except PySparkException as error:
            raise ToolError("db_read_failed", str(error).splitlines()[0], target_id=target_id) from error

    def read(self, target_id: str, sql: str, parameters: dict[str, Any] | None = None, max_rows: int | None = None, exact_total: bool = True) -> Result:
        """db_read: the answer normalized, capped, bounded in bytes and, where the target wants it, masked.

        The capped rows are kept between jobs, so that profile and mask see the same ones. The whole answer is counted by
        the read that finds the first rows; only an ordered answer is counted by a job of its own, as its first rows are
        found without sorting the rest. exact_total=False spares the count."""
        began = time.time()
        log = {"tool": "db_read", "target_id": target_id}
        try:
            whole = self.query(target_id, sql, parameters)
            target = self._target(target_id)
            self.audit.emit("query_in", log | {"sql": sql, "parameters": parameters, "max_rows": max_rows})
            self.audit.emit("db_driver_start", log)
            cap = results.row_cap(max_rows, target.max_rows)
            if exact_total and not dialect.ordered(sql):
                seen = Observation()
                heads = results.head(results.normalized(whole), cap, seen).persist()
                heads.count()
                first, total = self._keep(results.first_of(heads, cap)), seen.get["n"]
                first.count()
                heads.unpersist()  # only the first rows of all stay
            else:
                first = self._keep(results.capped(results.normalized(whole), cap))
                total = first.count()
                total = whole.count() if exact_total and total == cap else total
            kept = results.bounded(first, target.max_result_bytes)
            n, size = kept.agg(F.count("*"), F.coalesce(F.max("result_bytes"), F.lit(2))).first()
            rows = kept.drop("result_bytes")
            self.audit.emit("db_driver_done", log | {"row_count": n, "duration_ms": int(1000 * (time.time() - began))})
            out = Result(rows, results.columns_of(whole), n, size, target.max_result_bytes, n < total, 0, total, cap, anonymization_mode=target.anonymization_mode, sql=sql)
            if target.anonymization_enabled:
                self._mask(target, out, log)
            out.frame = out.frame.orderBy(results.PLACE).drop(results.PLACE)
            out.duration_ms = int(1000 * (time.time() - began))
            self.audit.emit("query_out", log | {"row_count": out.row_count, "truncated": out.truncated, "anonymization_applied": out.anonymization_applied, "anonymization_provider": out.anonymization_provider, "anonymization_mode": out.anonymization_mode})
            return out
        except Exception as error:
            self.audit.emit("query_failed", log | {"error": str(error).splitlines()[0] if str(error) else ""}, "error")
            if isinstance(error, ToolError):
                raise
            raise ToolError("db_read_failed", str(error).splitlines()[0] if str(error) else "", target_id=target_id) from error

    def _keep(self, rows: DataFrame) -> DataFrame:
        """Capped rows, persisted until KEPT later reads have been made; after that they are worked out anew if asked for."""
        self._kept.append(rows.persist())
        while len(self._kept) > KEPT:
            self._kept.popleft().unpersist()
        return rows

    def _mask(self, target: Target, out: Result, log: dict[str, Any]) -> None:
        """Replaces a result's rows by masked ones and bounds them anew; the columns stay as the source's."""
        self.audit.emit("anonymizer_start", log | {"provider": target.llm_provider, "mode": target.anonymization_mode})
        mode = "llm-strict" if target.anonymization_mode == "direct" else target.anonymization_mode
        known = classify.profiles(out.frame)
        fail_open = self.settings.fail_open and target.environment.strip().lower() != "prod"
        kinds = classify.resolve(out.frame, known, mode=mode, strategy=self.settings.strategy, classifier=self.classifier, fail_open=fail_open, cache=self.cache, sql=out.sql)
        masked = masked_frame(out.frame, self.settings.hash_salt, kinds, known, self.cache, out.sql)
        kept = results.bounded(masked, target.max_result_bytes, lenient_first=False)
        n, size = kept.agg(F.count("*"), F.coalesce(F.max("result_bytes"), F.lit(2))).first()
        out.truncated = out.truncated or n < out.row_count
        out.frame, out.row_count, out.result_bytes = kept.drop("result_bytes"), n, size
        out.anonymization_applied, out.anonymization_provider, out.anonymization_mode = True, target.llm_provider, mode
        self.audit.emit("anonymizer_done", log | {"row_count": n})

    # writes

    def plan_write(self, target_id: str, sql: str, parameters: dict[str, Any] | None = None) -> writes.Change:
        """What a guarded write would do, not done."""
        return self._planned(target_id, sql, parameters, lambda df: df)[0]

    def _planned(self, target_id: str, sql: str, parameters: dict[str, Any] | None, keep: writes.Keep) -> tuple[writes.Change, str]:
        """A write's change, and the list of its OUTPUT clause ('' for none)."""
        target, text = self._admit(target_id, "db_write", sql)
        self._ready(target, "db_write_failed")
        own = self.session(target)
        self._refresh(target, text)
        version = dict(self._sessions[target.target_id][1].versions)
        try:
            spelled, listed = dialect.with_output(text, parameters, self._kinds(target, text))
            if listed:
                guard.inspect_read(own, f"SELECT {listed} FROM touched")
            change = writes.change(own, guard.inspect_write(own, spelled), keep)
            change.version = version.get(change.table.lower(), 0)
            if listed:
                change.images().selectExpr(*dialect.outputs(listed))  # before anything is written
            return change, listed
        except guard.GuardError as error:
            raise ToolError("invalid_sql", str(error), target_id=target_id) from error

    def write(self, target_id: str, sql: str, parameters: dict[str, Any] | None = None) -> Result:
        """db_write: a new version of the table; the number of rows that the statement touched and, of those that its
        OUTPUT clause asks for, as many as the target's bytes hold."""
        began = time.time()
        log = {"tool": "db_write", "target_id": target_id}
        try:
            target = self._target(target_id)
            change, listed = self._planned(target_id, sql, parameters, lambda df: self._store(target).keep(df))
            self.audit.emit("query_in", log | {"sql": sql, "parameters": parameters})
            affected, images = self._store(target).apply(change, bool(listed))
            out = Result(self.spark.range(0), [], 0, 2, target.max_result_bytes, False, 0, rows_affected=affected, sql=sql)
            if images is not None:
                self._returned(out, images, listed)
            out.duration_ms = int(1000 * (time.time() - began))
            self.audit.emit("query_out", log | {"rows_affected": affected, "row_count": out.row_count, "truncated": out.truncated})
            return out
        except Exception as error:
            self.audit.emit("query_failed", log | {"error": str(error).splitlines()[0] if str(error) else ""}, "error")
            if isinstance(error, ToolError):
                raise
            raise ToolError("db_write_failed", str(error).splitlines()[0] if str(error) else "", target_id=target_id) from error

    def _returned(self, out: Result, images: DataFrame, listed: str) -> None:
        """What an OUTPUT clause makes of the touched rows: no cap of rows, so it may be any number of them."""
        chosen = images.selectExpr(*dialect.outputs(listed), results.PLACE)
        whole = results.normalized(chosen.drop(results.PLACE))
        rows = chosen.select(*(results.cell(F.col(results.quoted(f.name)), f.dataType).alias(f.name) for f in chosen.schema.fields if f.name != results.PLACE), results.PLACE)
        kept = self._keep(prefixes.within_bytes(rows, out.max_result_bytes_applied))
        n, size = kept.agg(F.count("*"), F.coalesce(F.max("result_bytes"), F.lit(2))).first()
        out.columns = results.columns_of(chosen.drop(results.PLACE))
        out.frame, out.row_count, out.result_bytes, out.truncated = kept.orderBy(results.PLACE).select(*map(results.quoted, whole.columns)), n, size, n < out.rows_affected

    # diagnostics

    def diagnose(self, database_target: str, query: str, target_id: str | None = None, ticket_key: str | None = None, parameters: dict[str, Any] | None = None) -> dict[str, Any]:
        """run_diagnostic_query: a read on the one target of an environment. Never raises; blockers say what failed."""
        target, blockers = policy.route(self.registry, database_target, target_id)
        result: Result | None = None
        if target:
            try:
                result = self.read(target.target_id, query, parameters)
            except ToolError as error:
                blockers = [str(error).strip() or "Diagnostic query failed."]
        rows = result.rows if result else []
        summary = {
            "target_id": target.target_id if target else None, "database_target": database_target, "ticket_key": metadata_value(ticket_key),
            "row_count": result.row_count if result else 0, "total_rows_before_limits": result.total_rows_before_limits if result else 0,
            "truncated": result.truncated if result else False, "anonymization_applied": result.anonymization_applied if result else False,
            "anonymization_provider": result.anonymization_provider if result else "none",
            "column_names": [c["name"] for c in result.columns] if result else [], "sample_rows": rows[:3], "duration_ms": result.duration_ms if result else 0,
        }
        return {"rows": rows, "summary": summary, "blockers": blockers}
