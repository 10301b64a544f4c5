"""Configuration of a run: a YAML or JSON file, overridden by the command line. Unknown names and bad values are refused."""

from __future__ import annotations

import importlib
import json
import os
from dataclasses import dataclass, field
from pathlib import Path

#: Sources and what they need; exactly one is given.
SOURCES = {
    "canonical": ["path"], "runs": ["path"], "observations": ["path"], "mlflow": ["path"], "atif": ["path"], "rollouts": ["path"],
    "langfuse_live": ["url", "since", "until"], "mlflow_live": ["url", "experiment"], "langsmith_live": ["url", "project"], "braintrust_live": ["url", "since", "until"], "intake_live": ["url", "workspace", "since", "until"],
}
OPTIONAL = {"limit", "since", "until", "batch", "project", "experiment", "evaluation", "filter", "sort", "page_size"}
#: Passes and their options with defaults.
PASSES = {
    "tool_issues": {"minimum_cases": 3, "retry_threshold": 3, "audit": False}, "anomalies": {"contamination": 0.02, "recurrence": 3, "features": [], "robust": False},
}


class ConfigError(ValueError):
    """A configuration that can't be run; the message names what is wrong."""


def register_source(name: str, needs: list[str]) -> None:
    """Allow a source of this name with the options that it needs, besides those of OPTIONAL."""
    _refuse(not name or name in SOURCES, f"source {name!r} is already there" if name else "a source needs a name")
    SOURCES[name] = list(needs)


@dataclass
class Config:
    source: str
    options: dict[str, object]
    passes: dict[str, dict[str, object]] = field(default_factory=lambda: {"tool_issues": dict(PASSES["tool_issues"]), "anomalies": dict(PASSES["anomalies"])})
    output: str = "-"
    existing: str | None = None
    artifacts: str | None = None


def _refuse(condition: bool, message: str) -> None:
    if condition:
        raise ConfigError(message)


def _passes(given: dict[str, object]) -> dict[str, dict[str, object]]:
    """true or {} means defaults, false off; at least one has to be on."""
    out = {}
    for name, value in given.items():
        _refuse(name not in PASSES, f"no pass {name!r}")
        if value is False:
            continue
        _refuse(value is not True and not isinstance(value, dict), f"{name}: true, false or options")
        own = {} if value is True else value
        unknown = set(own) - set(PASSES[name])
        _refuse(bool(unknown), f"{name}: no option {', '.join(sorted(unknown))}")
        out[name] = PASSES[name] | own
    _refuse(not out, "no pass is on")
    issues, odd = out.get("tool_issues"), out.get("anomalies")
    if issues:
        for k in ("minimum_cases", "retry_threshold"):
            _refuse(not isinstance(issues[k], int) or isinstance(issues[k], bool) or issues[k] < 1, f"tool_issues.{k} has to be 1 or more")
    if odd:
        _refuse(not isinstance(odd["contamination"], float) or not 0 < odd["contamination"] < 0.5, "anomalies.contamination has to lie between 0 and 0.5")
        _refuse(not isinstance(odd["recurrence"], int) or odd["recurrence"] < 2, "anomalies.recurrence has to be 2 or more")
        _refuse(len(set(odd["features"])) < len(odd["features"]), "anomalies.features are listed twice")
    return out


def parse(values: dict[str, object]) -> Config:
    unknown = set(values) - {"source", "passes", "output", "existing", "artifacts", "plugins"}
    _refuse(bool(unknown), f"no setting {', '.join(sorted(unknown))}")
    source = values.get("source")
    _refuse(not isinstance(source, dict) or len(source) != 1, "exactly one source has to be given")
    (name, options), = source.items()
    _refuse(name not in SOURCES, f"no source {name!r}")
    _refuse(not isinstance(options, dict), f"{name}: options are missing")
    lost = [k for k in SOURCES[name] if not options.get(k)]
    _refuse(bool(lost), f"{name}: {', '.join(lost)} missing")
    unknown = set(options) - set(SOURCES[name]) - OPTIONAL
    _refuse(bool(unknown), f"{name}: no option {', '.join(sorted(unknown))}")
    limit = options.get("limit", 1)
    _refuse(isinstance(limit, bool) or not str(limit).isdigit() or int(limit) < 1, f"{name}: limit has to be 1 or more")
    _refuse(name == "braintrust_live" and ("project" in options) == ("experiment" in options), "braintrust_live: either project or experiment")
    passes = values.get("passes", dict.fromkeys(PASSES, True))
    _refuse(not isinstance(passes, dict), "passes have to be names with options")
    return Config(name, dict(options), _passes(passes), str(values.get("output", "-")), values.get("existing"), values.get("artifacts"))


def read(path: str, overrides: dict[str, object] | None = None) -> Config:
    """A file's settings, with those of the command line in their place. Its plugins are modules that are imported first and register sources."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        values = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError:
            raise ConfigError(f"{path}: no JSON, and no YAML library is installed") from None
        values = yaml.safe_load(text)
    _refuse(not isinstance(values, dict), f"{path}: no settings")
    for module in values.get("plugins", []):
        try:
            importlib.import_module(module)
        except ImportError as error:
            raise ConfigError(f"plugin {module}: {error}") from None
    return parse(values | {k: v for k, v in (overrides or {}).items() if v is not None})


def secret(name: str, folder: str = ".") -> str | None:
    """A value of the environment, else of the .env file of a folder."""
    if name in os.environ:
        return os.environ[name]
    path = Path(folder, ".env")
    for line in path.read_text(encoding="utf-8").splitlines() if path.exists() else []:
        key, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and key.strip() == name:
            return value.strip().strip("'\"")
    return None
