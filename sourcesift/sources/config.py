"""Rule configuration files: JSON with rules, severityOverrides, suppressions and output flags."""

from __future__ import annotations

import json
import os

from sourcesift.operators.findings import merge_config


def load_config(path: str, base: dict | None = None) -> dict:
    """A configuration file over ``base`` (the default levels); ``extend`` names a further layer."""
    with open(path, encoding="utf-8") as handle:
        own = json.load(handle)
    merged = merge_config(base, own)
    if own.get("extend"):
        merged = load_config(os.path.join(os.path.dirname(path), own["extend"]), merged)
    return merged


def is_output_enabled(config: dict, name: str) -> bool:
    return config.get("output", {}).get(name) is not False
