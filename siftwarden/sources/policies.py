"""Policy and settings documents: JSON (and YAML where a parser is installed) to `Policy` and `engine.Settings`."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import replace
from pathlib import Path
from typing import Any

from siftwarden.operators.engine import Settings
from siftwarden.operators.policy import Policy

from .feeds import ALIASES


class Refused(ValueError):
    """A document that can't be used; `problems` has all that is wrong with it."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


def document(path: str) -> dict[str, Any]:
    text = Path(path).read_text()
    try:
        if path.endswith(".json"):
            doc = json.loads(text)
        else:
            import yaml

            doc = yaml.safe_load(text)
    except ImportError as e:
        raise RuntimeError(f"{path}: a YAML parser isn't installed; use JSON") from e
    except Exception as e:
        raise Refused([f"{path}: {e}"]) from e
    if not isinstance(doc, dict):
        raise Refused([f"{path}: not a mapping"])
    return doc


def policy_of(doc: Mapping[str, Any]) -> Policy:
    """The policy of a document of version 1; all problems are told at once."""
    problems: list[str] = [] if doc.get("version", 1) == 1 else [f"version: {doc['version']}"]

    def part(name: str, kind: type, of: Mapping[str, Any] = doc) -> Any:
        value = of.get(name)
        if value is None:
            return kind()
        if not isinstance(value, kind):
            problems.append(f"{name}: not a {'mapping' if kind is dict else 'list'}")
            return kind()
        return value

    rules, licences, engines, paths = (part(n, dict) for n in ("rules", "licenses", "engines", "paths"))
    blocked = []
    for k, b in enumerate(part("blocked_dependencies", list)):
        if isinstance(b, dict) and b.get("name"):
            blocked.append((ALIASES.get(e := str(b.get("ecosystem", "*")).lower(), e), str(b["name"]), str(b.get("reason", ""))))
        else:
            problems.append(f"blocked_dependencies at {k}: no name")
    sets = {k: tuple(map(str, part(k, list, licences))) for k in ("allowed", "warning", "blocked")}
    out = Policy(
        fail_on=str(doc.get("fail_on", "high")).lower(), gates={str(k).lower(): v for k, v in part("severity_gates", dict).items()}, max_risk=doc.get("max_risk_score"), ignored=tuple(map(str, part("ignore", list, rules))),
        overrides={str(k): str(v).lower() for k, v in part("severity_overrides", dict, rules).items()}, min_confidence=str(rules.get("min_confidence", "low")).lower(), licences=sets if any(sets.values()) else None,
        unknown_licence=str(licences.get("unknown", "warn")).lower(), blocked=tuple(blocked), engines=tuple(map(str, engines["enabled"])) if isinstance(engines.get("enabled"), list) else None,
        exclude=tuple(map(str, part("exclude", list, paths))), entropy_threshold=doc.get("entropy_threshold"),
    )
    problems += out.problems()
    if problems:
        raise Refused(problems)
    return out


def under(settings: Settings, policy: Policy) -> Settings:
    """Settings under a policy, which only adds: rules ignored, fewer engines, a higher floor, a lower entropy threshold."""
    order = ("low", "medium", "high")
    return replace(
        settings, engines=tuple(e for e in settings.engines if policy.engines is None or e in policy.engines), ignored=tuple(dict.fromkeys([*settings.ignored, *policy.ignored])), overrides=settings.overrides | policy.overrides,
        min_confidence=max(settings.min_confidence, policy.min_confidence, key=order.index), entropy_threshold=min(settings.entropy_threshold, policy.entropy_threshold or settings.entropy_threshold), unknown_licence=policy.unknown_licence,
    )


# What can be set from outside, with how a text is read.
_LIST = lambda s: tuple(x.strip() for x in (s.split(",") if isinstance(s, str) else s) if x.strip())
KEYS = {"engines": _LIST, "min_severity": str, "min_confidence": str, "ignored": _LIST, "entropy_threshold": float, "unknown_licence": str}
PREFIX = "SIFTWARDEN_"


def settings_of(*files: str, environment: Mapping[str, str] | None = None, **overrides: Any) -> Settings:
    """Settings by precedence: the defaults, each file that exists in turn, the environment, what the caller gives.

    A value that can't be read is passed over, so that it neither widens nor narrows a run.
    """
    env = os.environ if environment is None else environment
    layers: list[Mapping[str, Any]] = [document(f) for f in files if Path(f).is_file()]
    layers += [{k: env[PREFIX + k.upper()] for k in KEYS if env.get(PREFIX + k.upper())}, overrides]
    found: dict[str, Any] = {}
    for layer in layers:
        for k, v in layer.items():
            if k in KEYS and v is not None:
                try:
                    found[k] = KEYS[k](v)
                except (TypeError, ValueError):
                    continue
            elif k in ("overrides", "advisories", "licences", "rules") and v is not None and layer is overrides:
                found[k] = v
    return replace(Settings(), **found)
