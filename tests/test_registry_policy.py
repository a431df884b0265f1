import json

import pytest

from sluice import queries
from sluice.plans import policy
from sluice.sources import registry, settings
from sluice.sources.registry import ConfigError

MASKED = queries.MASKED


def one(**more):
    return queries.record("dev-main", "dev", **more)


def test_load_and_errors(tmp_path):
    path = tmp_path / "targets.json"
    with pytest.raises(ConfigError, match="Unable to read"):
        registry.load(str(path))
    path.write_text("{")
    with pytest.raises(ConfigError, match="not valid JSON"):
        registry.load(str(path))
    path.write_text("{}")
    with pytest.raises(ConfigError, match="Invalid targets"):
        registry.load(str(path))
    path.write_text(json.dumps({"other": 1, "targets": [one(extra="kept out")]}))
    assert [t.target_id for t in registry.load(str(path)).list()] == ["dev-main"]
    with pytest.raises(ConfigError, match="Duplicate target_id detected: dev-main"):
        registry.from_records([one(), one()])


@pytest.mark.parametrize(
    "bad",
    [
        {"max_rows": 0}, {"max_result_bytes": 1.5}, {"read_enabled": "yes"}, {"status": "gone"}, {"connection_env_var": "a-b"}, {"display_name": ""}, {"anonymization_mode": "hybrid"},
        {"llm_model": "m"}, {**MASKED, "llm_provider": "none"}, {"state": {"runtime_status": ""}}, {"allowed_tools": [""]}, {"db_kind": "oracle"},
    ],
)
def test_records_that_do_not_hold(bad):
    with pytest.raises(ConfigError):
        registry.from_records([one(**bad)])


def test_overrides_and_aliases():
    env = {"TARGET_DEV_MAIN_WRITE_ENABLED": "on", "TARGET_DEV_MAIN_READ_ENABLED": "", "TARGET_DEV_MAIN_LLM_MODEL": ""}
    t = registry.from_records([one(**MASKED)], env).require("dev-main")
    assert t.write_enabled and t.read_enabled and t.llm_model == "" and t.anonymization_mode == "deterministic"
    t = registry.from_records([one(**MASKED)], {"TARGET_DEV_MAIN_ANONYMIZATION_ENABLED": "0"}).require("dev-main")
    assert (t.anonymization_enabled, t.anonymization_mode, t.llm_provider, t.llm_model) == (False, "off", "none", "")
    with pytest.raises(ConfigError, match="must be a boolean"):
        registry.from_records([one()], {"TARGET_DEV_MAIN_READ_ENABLED": "maybe"})
    raw = one(**MASKED)
    raw |= {"anonymization_provider": raw.pop("llm_provider"), "anonymization_model": raw.pop("llm_model")}
    assert registry.from_records([raw]).require("dev-main").llm_provider == "ollama"
    with pytest.raises(ConfigError, match="Unknown target_id: x"):
        registry.from_records([one()]).require("x")


def test_decisions_in_python_and_in_spark_agree(spark):
    known = queries.registry()
    table = {(r.target_id, r.tool_name): r.asDict() for r in policy.matrix(known.frame(spark)).collect()}
    for t in known.list():
        assert len(policy.overview(t)["available_policies"]) == 4
        for tool in policy.TOOLS:
            assert table[t.target_id, tool] == {"target_id": t.target_id, **policy.decide(t, tool)}
    assert policy.decide(None, "db_read")["denial_reason"] == "Unknown target_id."
    assert policy.decide(known.list()[0], None) == {"tool_name": None, "allowed": None, "anonymization_required": None, "denial_reason": None}
    assert policy.decide(known.list()[0], "x")["denial_reason"] == "Unknown tool_name: x"
    assert "connection_env_var" not in policy.info_of(known.list()[0])


def test_routes():
    known = queries.registry()
    assert policy.route(known, "dev")[0].target_id == "dev-main"
    assert policy.route(known, "prod", "prod-two")[0].target_id == "prod-two"
    for environment, target_id, says in (("prod", None, "prod-main, prod-two"), ("ops", None, "No active"), ("dev", "x", "Unknown"), ("ops", "ops-archive", "not active"), ("dev", "lab", "belongs to")):
        target, blockers = policy.route(known, environment, target_id)
        assert target is None and says in blockers[0]
    assert "vault_locked (sealed)" in policy.runtime_blocker(known.require("lab"))
    assert policy.runtime_blocker(known.require("dev-main")) is None


def test_settings():
    s = settings.Settings.read({"LOG_LEVEL": "DEBUG", "DB_POOL_MAX": "3", "ALLOWED_ORIGINS": "https://a.example, "})
    assert (s.log_level, s.pool_max, s.request_timeout_ms) == ("debug", 3, 15_000)
    assert s.origin_allowed(None) and s.origin_allowed("https://a.example") and s.origin_allowed("http://localhost:9") and not s.origin_allowed("https://b.example")
    for bad in ({"DB_POOL_MAX": "x"}, {"LOG_FORMAT": "xml"}, {"ANON_FAIL_OPEN": "1"}, {"DB_POOL_MIN": "20"}):
        with pytest.raises(ConfigError):
            settings.Settings.read(bad)
    assert settings.dotenv("# c\nexport A='x y'\nB=2\n") == {"A": "x y", "B": "2"}
    with pytest.raises(ConfigError, match="MY_API_KEY"):
        settings.dotenv("MY_API_KEY=1")
