"""Configuration: environment over YAML over defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

_TRUE = ("1", "true", "yes", "on")
_NONE = ("", "null", "none")


@dataclass
class Config:
    max_iter: int = 100
    seed: int = 42
    runs: int = 3
    workers: int | None = None
    fraction_pct: float = 100.0
    directed: bool = False
    restrict_to_lcc: bool = True
    seeds: str | None = None
    output_dir: str = "results"


def _as(kind: str, value):
    if value is None or str(value).strip().lower() in _NONE:
        return None
    if "bool" in kind:
        return str(value).strip().lower() in _TRUE
    return int(value) if "int" in kind else float(value) if "float" in kind else str(value)


def load_config(path: str | None = None, env: dict[str, str] | None = None) -> Config:
    """Reads ``path`` (if there is one) and LOOMGRAPH_* variables; unset values keep their defaults."""
    given = {}
    if path and os.path.exists(path):
        import yaml

        with open(path) as f:
            given = yaml.safe_load(f) or {}
    env = os.environ if env is None else env
    out = Config()
    for f in fields(Config):
        value = _as(str(f.type), env.get(f"LOOMGRAPH_{f.name.upper()}", given.get(f.name)))
        if value is not None:
            setattr(out, f.name, value)
    return out


def run_seeds(cfg: Config, runs: int) -> list[int]:
    """seed, seed + 1, ... or the listed seeds, of which there must be one a run."""
    if runs < 1:
        raise ValueError("runs must be at least 1")
    if cfg.seeds:
        listed = [int(x) for x in cfg.seeds.split(",") if x.strip()]
        if len(listed) != runs:
            raise ValueError(f"{len(listed)} seeds for {runs} runs")
        return listed
    return [cfg.seed + i for i in range(runs)]


def worker_count(cfg: Config, given: int | None = None) -> int:
    """Cores of a local session: as given, else as configured, else those of the machine."""
    return given or cfg.workers or os.cpu_count() or 1
