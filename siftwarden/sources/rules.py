"""Rule packs: JSON (and YAML where a parser is installed) to rules; a bad pattern drops its rule."""

from __future__ import annotations

import json
import re
from pathlib import Path

from siftwarden.functions.severity import CONFIDENCES, SEVERITIES
from siftwarden.operators.detect import Rule


def _loads(path: Path) -> list[dict]:
    text = path.read_text(errors="ignore")
    if path.suffix == ".json":
        return json.loads(text).get("rules", [])
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError(f"{path}: a YAML parser isn't installed; use JSON") from e
    return (yaml.safe_load(text) or {}).get("rules", [])


def pack(entries: list[dict]) -> tuple[list[Rule], list[str]]:
    """Rules, and what is wrong with entries that gave none."""
    rules, problems = [], []
    for e in entries:
        name = e.get("id", "<no id>")
        try:
            for p in filter(None, (e["pattern"], e.get("exclude") or e.get("exclude_if_matches"))):
                re.compile(p)
        except (KeyError, re.error) as x:
            problems.append(f"{name}: {x}")
            continue
        severity, confidence = e.get("severity", "medium"), e.get("confidence", "medium")
        if severity not in SEVERITIES or confidence not in CONFIDENCES:
            problems.append(f"{name}: severity {severity}, confidence {confidence}")
            continue
        rules.append(Rule(name, severity, e["pattern"], tuple(e.get("languages", ["*"])), e.get("exclude") or e.get("exclude_if_matches"), confidence, e.get("category", "code"), whole=bool(e.get("multiline"))))
    return rules, problems


def read_packs(directory: str) -> tuple[list[Rule], list[str]]:
    """All packs of a folder in the order of their names."""
    entries = [e for p in sorted(Path(directory).iterdir()) if p.suffix in (".json", ".yml", ".yaml") for e in _loads(p)]
    return pack(entries)
