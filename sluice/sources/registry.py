"""Targets: named, policy-bearing sets of tables. Loading, validation, overrides and look-up."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, fields, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: What the fields of a record may hold; the texts of problems are fixed values too.
MODES = ("off", "direct", "deterministic", "hybrid", "llm-strict")
PROVIDERS = ("none", "lmstudio", "ollama")
STATUSES = ("active", "disabled")

STATE = "struct<runtime_status: string, last_synced_at: string, last_error: string>"
SCHEMA = (
    "target_id string, display_name string, environment string, db_kind string, status string, connection_env_var string, "
    "read_enabled boolean, write_enabled boolean, anonymization_enabled boolean, anonymization_mode string, llm_provider string, "
    f"llm_model string, max_rows int, max_result_bytes int, allowed_tools array<string>, state {STATE}"
)


class ConfigError(ValueError):
    """A configuration that can't be used."""


@dataclass(frozen=True)
class Target:
    target_id: str
    display_name: str
    environment: str
    db_kind: str
    status: str
    connection_env_var: str
    read_enabled: bool
    write_enabled: bool
    anonymization_enabled: bool
    anonymization_mode: str
    llm_provider: str
    llm_model: str
    max_rows: int
    max_result_bytes: int
    allowed_tools: tuple[str, ...] = ()
    state: Mapping[str, Any] | None = None

    @property
    def active(self) -> bool:
        return self.status == "active"

    @property
    def runtime_status(self) -> str | None:
        return (self.state or {}).get("runtime_status")

    def problems(self) -> list[str]:
        """What is wrong with this record; empty if nothing is."""
        out = []
        for f in fields(self):
            value = getattr(self, f.name)
            if f.type == "bool" and not isinstance(value, bool):
                out.append(f"{f.name} must be a boolean.")
            if f.type == "int" and (isinstance(value, bool) or not isinstance(value, int) or value <= 0):
                out.append(f"{f.name} must be a positive integer.")
            if f.type == "str" and not isinstance(value, str):
                out.append(f"{f.name} must be a string.")
            elif f.type == "str" and not value and f.name != "llm_model":
                out.append(f"{f.name} must not be empty.")
        choices = {"status": STATUSES, "anonymization_mode": MODES, "llm_provider": PROVIDERS, "db_kind": ("spark", "sqlserver")}
        out += [f"{name} must be one of: {', '.join(allowed)}." for name, allowed in choices.items() if getattr(self, name) not in allowed]
        if isinstance(self.connection_env_var, str) and not re.fullmatch(r"[A-Z0-9_]+", self.connection_env_var):
            out.append("connection_env_var must hold A-Z, 0-9 and _ only.")
        if not all(isinstance(t, str) and t for t in self.allowed_tools):
            out.append("allowed_tools must be a list of names.")
        if self.state is not None and (not isinstance(self.state, Mapping) or self.state.get("runtime_status", "x") in ("", None)):
            out.append("state.runtime_status must not be empty.")
        if self.anonymization_enabled is False:
            off = {"anonymization_mode": "off", "llm_provider": "none", "llm_model": ""}
            out += [f'{name} must be "{value}" when anonymization is disabled.' for name, value in off.items() if getattr(self, name) != value]
        elif self.llm_provider == "none":
            out.append('llm_provider cannot be "none" when anonymization is enabled.')
        return out


def flag(text: Any, label: str) -> bool:
    """A boolean from an override's text."""
    word = str(text).strip().lower()
    known = dict.fromkeys(("1", "true", "yes", "on"), True) | dict.fromkeys(("0", "false", "no", "off"), False)
    if word not in known:
        raise ConfigError(f"{label} must be a boolean value.")
    return known[word]


def with_overrides(raw: Mapping[str, Any], env: Mapping[str, str]) -> dict[str, Any]:
    """A raw record with its older field names filled in and with what TARGET_<ID>_* variables say.

    Switching anonymization off resets its mode, provider and model. An empty LLM_MODEL counts, other empty ones don't.
    """
    out = dict(raw)
    for name, older in (("llm_provider", "anonymization_provider"), ("llm_model", "anonymization_model")):
        if name not in out and older in out:
            out[name] = out[older]
    prefix = "TARGET_" + re.sub(r"[^A-Za-z0-9]+", "_", str(out.get("target_id") or "").strip()).strip("_").upper()
    for name in ("READ_ENABLED", "WRITE_ENABLED", "ANONYMIZATION_ENABLED"):
        if value := env.get(f"{prefix}_{name}"):
            out[name.lower()] = flag(value, f"{prefix}_{name}")
    for name in ("ANONYMIZATION_MODE", "LLM_PROVIDER"):
        if value := env.get(f"{prefix}_{name}"):
            out[name.lower()] = value.strip().lower()
    if (value := env.get(f"{prefix}_LLM_MODEL")) is not None:
        out["llm_model"] = value.strip()
    if out.get("anonymization_enabled") is False and (env.get(f"{prefix}_ANONYMIZATION_ENABLED") or any(env.get(f"{prefix}_{n}") is not None for n in ("ANONYMIZATION_MODE", "LLM_PROVIDER", "LLM_MODEL"))):
        out |= {"anonymization_mode": "off", "llm_provider": "none", "llm_model": ""}
    return out


class Registry:
    """Targets in the order in which they were given; ids are unique."""

    def __init__(self, targets: Iterable[Target]):
        self._by_id: dict[str, Target] = {}
        for target in targets:
            if target.target_id in self._by_id:
                raise ConfigError(f"Duplicate target_id detected: {target.target_id}")
            self._by_id[target.target_id] = target

    def list(self) -> list[Target]:
        return list(self._by_id.values())

    def get(self, target_id: str) -> Target | None:
        return self._by_id.get(target_id)

    def require(self, target_id: str) -> Target:
        if target_id not in self._by_id:
            raise ConfigError(f"Unknown target_id: {target_id}")
        return self._by_id[target_id]

    def __len__(self) -> int:
        return len(self._by_id)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The registry as a table."""
        rows = [asdict(t) | {"allowed_tools": list(t.allowed_tools), "state": {k: (t.state or {}).get(k) for k in ("runtime_status", "last_synced_at", "last_error")} if t.state else None} for t in self.list()]
        return spark.createDataFrame(rows, SCHEMA)


def from_records(records: Any, env: Mapping[str, str] | None = None) -> Registry:
    if not isinstance(records, list):
        raise ConfigError("Invalid targets configuration: targets must be a list.")
    names = {f.name for f in fields(Target)}
    targets = []
    for raw in records:
        if not isinstance(raw, Mapping):
            raise ConfigError("Invalid targets configuration: a target must be an object.")
        full = with_overrides(raw, env or {})
        if missing := sorted(names - set(full) - {"allowed_tools", "state"}):
            raise ConfigError(f"Invalid targets configuration: missing {', '.join(missing)}.")
        target = Target(**{k: v for k, v in full.items() if k in names})
        target = replace(target, allowed_tools=tuple(target.allowed_tools))
        if problems := target.problems():
            raise ConfigError(f"Invalid targets configuration: {' '.join(problems)}")
        targets.append(target)
    return Registry(targets)


def load(path: str, env: Mapping[str, str] | None = None) -> Registry:
    """The registry of a JSON file {"targets": [...]}; other keys are left alone."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except OSError as error:
        raise ConfigError(f"Unable to read targets file at {path}: {error}") from error
    try:
        parsed = json.loads(text)
    except ValueError as error:
        raise ConfigError(f"{path} is not valid JSON: {error}") from error
    return from_records(parsed.get("targets") if isinstance(parsed, dict) else None, env)
