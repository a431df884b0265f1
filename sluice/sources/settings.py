"""Settings from environment variables, and dotenv files that may not hold secrets."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from urllib.parse import urlsplit

from sluice.sources.registry import ConfigError

#: Endings of names that a dotenv file may not set.
SECRET_ENDINGS = ("CONNECTION_STRING", "API_KEY", "ACCESS_TOKEN", "AUTH_TOKEN", "SECRET", "PASSWORD")
LEVELS = ("error", "info", "debug")


def whole(env: Mapping[str, str], name: str, default: int, least: int = 0) -> int:
    text = env.get(name) or ""
    try:
        value = int(text) if text else default
    except ValueError:
        raise ConfigError(f"{name} must be an integer.") from None
    if value < least:
        raise ConfigError(f"{name} must be at least {least}.")
    return value


def choice(env: Mapping[str, str], name: str, allowed: tuple[str, ...], default: str) -> str:
    value = (env.get(name) or default).strip().lower()
    if value not in allowed:
        raise ConfigError(f"{name} must be one of: {', '.join(allowed)}.")
    return value


def truth(env: Mapping[str, str], name: str, default: bool) -> bool:
    value = env.get(name) or str(default).lower()
    if value not in ("true", "false"):
        raise ConfigError(f'Boolean value expected, received "{value}".')
    return value == "true"


@dataclass(frozen=True)
class Settings:
    """connection and pool figures are for JDBC targets; Spark owns the resources of local ones."""

    log_level: str = "info"
    log_format: str = "json"
    session_ttl_ms: int = 1_800_000
    session_sweep_ms: int = 60_000
    connection_timeout_ms: int = 15_000
    request_timeout_ms: int = 15_000
    pool_max: int = 10
    pool_min: int = 0
    pool_idle_ms: int = 30_000
    classifier_timeout_ms: int = 5_000
    strategy: str = "hybrid"
    fail_open: bool = False
    hash_salt: str = ""
    origins: tuple[str, ...] = ()
    loopback_origins: bool = True

    @classmethod
    def read(cls, env: Mapping[str, str]) -> Settings:
        out = cls(
            log_level=choice(env, "LOG_LEVEL", LEVELS, "info"),
            log_format=choice(env, "LOG_FORMAT", ("json", "plain"), "json"),
            session_ttl_ms=whole(env, "SESSION_TTL_MS", 1_800_000),
            session_sweep_ms=whole(env, "SESSION_SWEEP_INTERVAL_MS", 60_000, 1),
            connection_timeout_ms=whole(env, "DB_CONNECTION_TIMEOUT_MS", 15_000, 1),
            request_timeout_ms=whole(env, "DB_REQUEST_TIMEOUT_MS", 15_000, 1),
            pool_max=whole(env, "DB_POOL_MAX", 10, 1),
            pool_min=whole(env, "DB_POOL_MIN", 0),
            pool_idle_ms=whole(env, "DB_POOL_IDLE_TIMEOUT_MS", 30_000),
            classifier_timeout_ms=whole(env, "ANON_TIMEOUT_MS", 5_000, 1),
            strategy=choice(env, "ANON_FIELD_IDENTIFICATION", ("hybrid", "heuristic", "llm"), "hybrid"),
            fail_open=truth(env, "ANON_FAIL_OPEN", False),
            hash_salt=env.get("ANON_HASH_SALT", ""),
            origins=tuple(o.strip() for o in env.get("ALLOWED_ORIGINS", "").split(",") if o.strip()),
            loopback_origins=truth(env, "ALLOW_LOOPBACK_ORIGINS", True),
        )
        if out.pool_min > out.pool_max:
            raise ConfigError("DB_POOL_MIN must not exceed DB_POOL_MAX.")
        return out

    def origin_allowed(self, origin: str | None) -> bool:
        if not origin or origin in self.origins:
            return True
        try:
            name = urlsplit(origin).hostname
        except ValueError:
            return False
        return self.loopback_origins and name in ("localhost", "127.0.0.1", "::1")

    def jdbc_options(self, url: str, sql: str) -> dict[str, str]:
        """Options for spark.read.format("jdbc"); the driver's jar is the caller's."""
        return {"url": url, "query": sql, "queryTimeout": str(-(-self.request_timeout_ms // 1000)), "loginTimeout": str(-(-self.connection_timeout_ms // 1000))}


def dotenv(text: str) -> dict[str, str]:
    """The pairs of a dotenv text; a name that says it holds a secret is refused."""
    out = {}
    for line in text.splitlines():
        name, equals, value = line.strip().removeprefix("export ").partition("=")
        if equals and not name.startswith("#"):
            value = value.strip()
            out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    if secret := sorted(k for k in out if k.upper().endswith(SECRET_ENDINGS)):
        raise ConfigError(f"Secrets don't belong in a dotenv file: {', '.join(secret)}")
    return out
