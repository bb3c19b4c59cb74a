"""A project's settings: defaults, a strict reader of TOML, profiles, and a self-check.

A file that can't be read, a setting that isn't known and a value of another kind are errors: a gate that was set must never be off because of a slip."""

from __future__ import annotations

import copy
import tomllib

# The settings and what holds without a file. A tuple lists the words that a setting may be, the first of them its default.
_LEVEL = ("warn", "off", "fail")
_STRICT_LEVEL = ("fail", "off", "warn")
SETTINGS = {
    "scan": {"exclude_patterns": [], "extra_patterns": [{"name": "", "regex": ""}], "entropy": True, "entropy_threshold": 4.5, "entropy_min_length": 20},
    "coverage": {"min": 80.0, "file": "coverage/lcov.info"},
    "lint": {"target_dir": "."},
    "docker": {"dockerfile": "Dockerfile"},
    "sast": {"enabled": True, "disabled_rules": [], "max_function_lines": 50, "max_parameters": 5, "max_nesting_depth": 4, "custom_rules": [{"id": "", "query": ""}]},
    "pipeline": {"steps": [], "fail_fast": False},
    "audit": {"ignore_advisories": [], "source": ("auto", "online", "offline"), "max_db_age_hours": 24},
    "review": {"min_new_code_coverage": 80.0, "complexity_budget": 0},
    "policy": {"on_incomplete": ("fail", "warn"), "max_exception_days": 90},
    "deps": {"exclude_patterns": []},
    "dependency_review": {
        "fail_on_severity": ("high", "low", "medium", "critical"), "fail_on": ["new_advisory", "release_risk", "denied_license", "source_policy"], "deny_licenses": [], "allow_licenses": [], "unknown_license": _LEVEL,
    },
    "supply_chain": {
        "block_phantom_scripts": True, "enforce_sandbox": True, "allow_postinstall": [], "allow_pip_packages": [], "allow_cargo_crates": [], "slopsquat_check": True, "slopsquat_min_age_days": 90,
        "slopsquat_min_downloads": 1000, "internal_packages": [], "require_isolation": False, "script_network": [], "env_allow": [],
        "release": {"min_release_age_hours": 24, "young_release": _LEVEL, "new_install_script": _STRICT_LEVEL, "provenance_regression": _STRICT_LEVEL, "publisher_change": _LEVEL, "withdrawn": _LEVEL, "missing_integrity": _LEVEL},
        "registries": [{"pattern": "", "url": "", "ecosystems": []}],
        "sources": {"git": _LEVEL, "url": _LEVEL, "path": ("off", "warn", "fail")},
    },
    "triage": {"enabled": True, "model": "", "api_key_env": "", "endpoint": "", "auto_suppress_threshold": 0.0, "context_lines": 10},
    "sbom": {"default_output": "sbom.json", "expected_issuer": "", "expected_identity": ""},
    "telemetry": {"enabled": True, "otlp_endpoint": "", "service_name": "", "metrics_file": ""},
}
#: Sections of older files that are read over, with a warning.
GONE = ("lighthouse", "reassure")
#: What "strict" raises from a warning to a failure; what is off stays off.
RAISED = ("supply_chain.release.young_release", "supply_chain.release.withdrawn", "supply_chain.release.missing_integrity", "supply_chain.sources.git", "supply_chain.sources.url", "dependency_review.unknown_license")
SMELLS = ("SMELL/LongFunction", "SMELL/TooManyParameters", "SMELL/DeepNesting")
PROFILES = ("strict", "relaxed", "ci")


class SettingsError(ValueError):
    """A settings file that doesn't hold what it should."""


def _default(shape):
    if isinstance(shape, dict):
        return {k: _default(v) for k, v in shape.items()}
    if isinstance(shape, tuple):
        return shape[0]
    return [] if isinstance(shape, list) and shape and isinstance(shape[0], dict) else copy.copy(shape)


def _read(value, shape, where: str):
    if isinstance(shape, tuple):
        if value not in shape:
            raise SettingsError(f"{where}: {value!r} is none of {', '.join(shape)}")
        return value
    if isinstance(shape, dict):
        if not isinstance(value, dict):
            raise SettingsError(f"{where}: no table")
        if unknown := [k for k in value if k not in shape]:
            raise SettingsError(f"{where}: unknown setting {unknown[0]!r}")
        return {k: _read(value[k], v, f"{where}.{k}".lstrip(".")) if k in value else _default(v) for k, v in shape.items()}
    if isinstance(shape, list):
        if not isinstance(value, list):
            raise SettingsError(f"{where}: no list")
        inner = shape[0] if shape and isinstance(shape[0], dict) else tuple(shape) if shape else ""
        return [_read(v, inner, f"{where}[{i}]") for i, v in enumerate(value)]
    if isinstance(shape, float) and type(value) is int:
        return float(value)
    if type(value) is not type(shape) or (type(shape) is int and value < 0):
        raise SettingsError(f"{where}: {value!r} isn't of the kind {type(shape).__name__}")
    return value


def load(text: str | None) -> tuple[dict, list[str]]:
    """(settings, warnings) of a file's text; None: there is no file, the defaults hold."""
    try:
        doc = tomllib.loads(text or "")
    except tomllib.TOMLDecodeError as e:
        raise SettingsError(str(e)) from e
    warnings = [f"section {s} has no effect any more" for s in GONE if s in doc]
    return _read({k: v for k, v in doc.items() if k not in GONE}, SETTINGS, ""), warnings


def _at(settings: dict, path: str) -> tuple[dict, str]:
    *tables, key = path.split(".")
    for t in tables:
        settings = settings[t]
    return settings, key


def overlaid(settings: dict, profile: str) -> dict:
    """The settings under a profile, which only ever moves a threshold its own way: strict, relaxed, or ci."""
    if profile not in PROFILES:
        raise SettingsError(f"no profile {profile!r}")
    out = copy.deepcopy(settings)

    def move(path: str, to: float, choose) -> None:
        table, key = _at(out, path)
        table[key] = choose(table[key], to)

    if profile == "strict":
        for path in RAISED:
            table, key = _at(out, path)
            table[key] = "fail" if table[key] == "warn" else table[key]
        out["dependency_review"]["fail_on_severity"] = "low"
        move("coverage.min", 90.0, max)
        move("review.min_new_code_coverage", 90.0, max)
        move("scan.entropy_threshold", 3.5, min)
        out["sast"]["enabled"] = True
    elif profile == "relaxed":
        move("coverage.min", 70.0, min)
        move("scan.entropy_threshold", 5.0, max)
    else:
        move("coverage.min", 80.0, max)
        out["sast"]["enabled"] = True
        out["sast"]["disabled_rules"] += [r for r in SMELLS if r not in out["sast"]["disabled_rules"]]
    return out


def flat(settings: dict, under: str = "") -> list[tuple[str, str]]:
    """(setting, value) of all settings, in their order."""
    out = []
    for k, v in settings.items():
        out += flat(v, f"{under}{k}.") if isinstance(v, dict) else [(f"{under}{k}", str(v).lower() if isinstance(v, bool) else str(v))]
    return out


def check(text: str | None, exceptions: str | None = None, today: str | None = None, soon: int = 14) -> dict:
    """What the files come to: ``ok``, ``errors``, ``warnings``, ``resolved`` settings, and how many exceptions are expired or about to be."""
    import datetime

    from .sources.manifests import exceptions as read

    out = {"ok": True, "errors": [], "warnings": [], "resolved": [], "expired": 0, "expiring": 0}
    try:
        settings, out["warnings"] = load(text)
        out["resolved"] = flat(settings)
    except SettingsError as e:
        out["errors"].append(str(e))
    if exceptions is not None:
        found, wrong = read(exceptions)
        out["errors"] += wrong
        now = datetime.date.fromisoformat(today) if today else datetime.date.today()
        for e in found:
            try:
                left = (datetime.date.fromisoformat(e["expires"]) - now).days
            except ValueError:
                continue  # told by the reader
            out["expired" if left < 0 else "expiring"] += left < soon
    out["ok"] = not out["errors"]
    return out
