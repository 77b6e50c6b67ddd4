"""Thresholds of the engine: defaults, overrides and environment, checked."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields, replace
from math import floor

MULTIPLIERS = {"conservative": 1.5, "moderate": 1.0, "aggressive": 0.6}
ENV_PREFIX = "LOOMDIGEST_"


@dataclass(frozen=True)
class Config:
    enabled: bool = True
    tool_output_max_tokens: int = 1200
    patch_max_tokens: int = 600
    file_content_max_tokens: int = 1000
    message_max_tokens: int = 3000
    summary_max_lines: int = 40
    aggressiveness: str = "moderate"
    preserve_patterns: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.aggressiveness not in MULTIPLIERS:
            raise ValueError(f"aggressiveness must be one of {', '.join(MULTIPLIERS)}")
        for f in fields(self):
            value = getattr(self, f.name)
            if f.type == "int" and value < 1:
                raise ValueError(f"{f.name} must be positive")

    @property
    def multiplier(self) -> float:
        return MULTIPLIERS[self.aggressiveness]


def resolve_config(env: Mapping[str, str] | None = None, overrides: Mapping[str, object] | None = None) -> Config:
    """Environment before overrides before defaults; what does not parse falls through."""
    env, overrides, chosen = env or {}, overrides if isinstance(overrides, Mapping) else {}, {}
    for f in fields(Config):
        for value in (env.get(ENV_PREFIX + f.name.upper()), overrides.get(f.name)):
            parsed = _parse(f.type, value)
            if parsed is not None:
                chosen[f.name] = parsed
                break
    return Config(**chosen)


def _parse(kind: str, value: object) -> object | None:
    if kind == "bool":
        return value if isinstance(value, bool) else {"true": True, "1": True, "false": False, "0": False}.get(str(value).lower())
    if kind == "int":
        if not isinstance(value, (int, float, str)) or isinstance(value, bool):
            return None
        try:
            whole = floor(float(value) + 0.5)
        except (ValueError, OverflowError):
            return None
        return whole if whole >= 1 else None
    if kind.startswith("tuple"):
        return None if value is None else patterns(value)
    return value if value in MULTIPLIERS else None


def patterns(value: object) -> tuple[str, ...]:
    """The valid regular expressions of a list, or of a text apart by commas."""
    parts: Iterable[object] = value.split(",") if isinstance(value, str) else value if isinstance(value, (list, tuple)) else ()
    found = []
    for part in parts:
        text = str(part).strip()
        try:
            re.compile(text)
        except re.error:
            continue
        if text:
            found.append(text)
    return tuple(found)


#: Bounds within which limits can be set at run time.
BOUNDS = {"tool_output_max_tokens": (100, 5000), "patch_max_tokens": (100, 3000), "file_content_max_tokens": (200, 5000)}


#: Bounds that the settings given at start are checked against.
START_BOUNDS = BOUNDS | {"message_max_tokens": (500, 10000), "summary_max_lines": (5, 200)}


def problems(overrides: object) -> list[str]:
    """What is wrong with settings given at start: unknown names, kinds, and limits out of bounds."""
    if not isinstance(overrides, Mapping):
        return ["settings must be a mapping"]
    kinds, found = {f.name: f.type for f in fields(Config)}, []
    for name, value in overrides.items():
        kind = kinds.get(name)
        if kind is None:
            found.append(f"{name}: unknown")
        elif kind == "bool" and not isinstance(value, bool):
            found.append(f"{name}: must be true or false")
        elif kind == "int" and (isinstance(value, bool) or not isinstance(value, (int, float)) or value != value or value % 1):
            found.append(f"{name}: must be a whole number")
        elif kind == "int" and not START_BOUNDS[name][0] <= value <= START_BOUNDS[name][1]:
            found.append("{}: must be from {} to {}".format(name, *START_BOUNDS[name]))
        elif kind == "str" and value not in MULTIPLIERS:
            found.append(f"{name}: must be one of {', '.join(MULTIPLIERS)}")
        elif str(kind).startswith("tuple") and not (isinstance(value, (list, tuple)) and all(isinstance(v, str) for v in value)):
            found.append(f"{name}: must be a list of texts")
    return found


def load_config(env: Mapping[str, str] | None = None, overrides: Mapping[str, object] | None = None) -> Config:
    """``resolve_config`` of settings without problems; ValueError names those there are."""
    wrong = problems(overrides or {})
    if wrong:
        raise ValueError("; ".join(wrong))
    return resolve_config(env, overrides)


def configure(config: Config, **changes: object) -> Config:
    """The configuration with the valid changes, limits held within their bounds; ValueError if none is valid."""
    valid: dict[str, object] = {}
    for f in fields(Config):
        value = _parse(f.type, changes.get(f.name)) if f.name in changes else None
        if value is not None:
            low, high = BOUNDS.get(f.name, (None, None))
            valid[f.name] = value if low is None else min(max(value, low), high)  # type: ignore[type-var]
    if not valid:
        raise ValueError("no valid configuration changes")
    return replace(config, **valid)  # type: ignore[arg-type]
