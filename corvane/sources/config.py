"""Typed settings: a YAML-like mapping gives defaults, the command line wins, variables are read from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class TierSettings:
    s_percentile: float = 75
    a_percentile: float = 25
    weights: dict[str, float] = field(default_factory=lambda: {"S": 3.0, "A": 2.0, "B": 1.0})


@dataclass(frozen=True)
class Settings:
    tasks: dict[str, str] = field(default_factory=dict)
    tier: TierSettings = field(default_factory=TierSettings)
    conflict_threshold: float = 0.4
    conflict_downweight: float = 0.5
    val_ratio: float = 0.05
    seed: int = 42

    @classmethod
    def of(cls, raw: dict[str, Any]) -> Settings:
        known = {k: v for k, v in raw.items() if k in cls.__dataclass_fields__}
        if isinstance(known.get("tier"), dict):
            known["tier"] = TierSettings(**known["tier"])
        return cls(**known)


def with_defaults(defaults: dict[str, Any], given: dict[str, Any]) -> dict[str, Any]:
    """Names may use - for _; what is given (not None) wins."""
    out = {k.replace("-", "_"): v for k, v in defaults.items()}
    return out | {k.replace("-", "_"): v for k, v in given.items() if v is not None}


def env(name: str, default: str) -> str:
    return os.environ.get(name) or default


def required(name: str) -> str:
    if not os.environ.get(name):
        raise KeyError(f"{name} is not set")
    return os.environ[name]


def task_set(choice: str, known: list[str]) -> list[str]:
    return list(known) if choice == "all" else [t.strip() for t in choice.split(",") if t.strip()]
