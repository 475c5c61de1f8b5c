"""Settings: defaults, a file over them, and the environment over both."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping


def merge(base: Mapping, over: Mapping) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def coerce(text: str) -> bool | int | float | str:
    """true and false, whole numbers and numbers by their looks; anything else stays text."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def from_environment(prefix: str = "QUERN_", environ: Mapping[str, str] | None = None) -> dict:
    """QUERN_A__B=1 sets b within a."""
    out: dict = {}
    for k, v in (os.environ if environ is None else environ).items():
        if k.startswith(prefix):
            at = out
            *path, last = k[len(prefix) :].lower().split("__")
            for p in path:
                at = at.setdefault(p, {})
            at[last] = coerce(v)
    return out


def load(defaults: Mapping, path: str | None = None, prefix: str = "QUERN_") -> dict:
    over = {}
    if path:
        with open(path) as f:
            over = json.load(f)
    return merge(merge(defaults, over), from_environment(prefix))
