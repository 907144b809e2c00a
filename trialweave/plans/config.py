"""Settings: defaults, a file's values merged over them, environment variables over both."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from typing import Any

#: Defaults of retrieval, linking, constraints and reasoning.
DEFAULTS: dict[str, Any] = {
    "search": {"mode": "hybrid", "vector_weight": 0.5, "candidate_limit": 1000, "vector_score_threshold": 0.5, "max_trials_first_level": 1000, "max_trials_second_level": 100, "keep_divisor": 3, "fusion": "rrf", "rrf_k": 60},
    "first_level": {"per_channel_size": 600, "max_other_conditions": 25, "llm_expansion_enabled": False, "llm_max_terms": 12, "hard_filters": None},
    "second_level": {"size": 250, "threshold": 0.5, "method": "weighted"},
    "constraints": {"enabled": True, "score_weight": 0.25},
    "linker": {"accept": 0.7, "reject": 0.5, "margin": 0.05, "limit": 10},
    "rag": {"enabled": True, "max_trials": 20},
    "embedder": {"name": "hashing", "dimensions": 64, "normalize": True, "native_metric": None},
    "registry": {"since_days": 7, "failure_threshold": 0.25},
}
PREFIX = "TRIALWEAVE_"


def merged(base: Mapping, over: Mapping) -> dict:
    """Nested mappings merge; an empty mapping changes nothing."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def _typed(text: str, like: Any) -> Any:
    if isinstance(like, bool):
        if text.lower() not in ("1", "0", "true", "false", "yes", "no", "on", "off"):
            raise ValueError(f"not a boolean: {text!r}")
        return text.lower() in ("1", "true", "yes", "on")
    if isinstance(like, (int, float)):
        return type(like)(text)
    return text


def load(path: str | None = None, environ: Mapping[str, str] = os.environ) -> dict:
    """Settings; TRIALWEAVE_SECTION__KEY overrides a key. Unknown sections of a file are an error, null keeps nothing."""
    cfg = DEFAULTS
    if path:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        if unknown := set(given) - set(DEFAULTS):
            raise ValueError(f"unknown sections {sorted(unknown)}")
        cfg = merged(cfg, given)
    over: dict[str, dict] = {}
    for name, value in environ.items():
        if name.startswith(PREFIX) and "__" in name:
            section, key = name[len(PREFIX) :].lower().split("__", 1)
            if key in cfg.get(section, {}):
                over.setdefault(section, {})[key] = _typed(value, cfg[section][key])
    check = merged(cfg, over)
    if check["linker"]["reject"] > check["linker"]["accept"]:
        raise ValueError("linker.reject is above linker.accept")
    return check
