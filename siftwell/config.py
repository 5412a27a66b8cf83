"""Configuration as plain data, with environment sections and checks."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields
from pathlib import Path

from siftwell.errors import InvalidConfigError, MissingConfigError


@dataclass(frozen=True)
class SearchConfig:
    rrf_k: int = 60
    alpha: float = 0.95
    fusion: str = "weighted_sum"
    rerank_pool: int = 64
    limit: int = 20
    least_limit: int = 1
    most_limit: int = 100
    query_length: tuple[int, int] = (2, 1000)
    threshold: float = 0.3
    fallback_threshold: float = 0.1
    relaxed_threshold: float = 0.05
    tag_boost: float = 1.1
    title_weight: float = 1.0
    content_weight: float = 0.4
    diversify: bool = True
    domain_boost: bool = False


@dataclass(frozen=True)
class ChunkConfig:
    tokens: int = 400
    characters: int = 2000
    overlap: int = 200
    heading_levels: tuple[int, ...] = (1, 2, 3)


@dataclass(frozen=True)
class Config:
    path: str = ""
    dimensions: int = 1024
    search: SearchConfig = field(default_factory=SearchConfig)
    chunk: ChunkConfig = field(default_factory=ChunkConfig)


def _build(kind: type, values: dict):
    known = {f.name: f for f in fields(kind)}
    if unknown := set(values) - set(known):
        raise InvalidConfigError(f"unknown settings: {', '.join(sorted(unknown))}")
    parts = {"search": SearchConfig, "chunk": ChunkConfig}
    return kind(**{k: _build(parts[k], v) if k in parts and isinstance(v, dict) else tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def load(path: str, environment: str | None = None) -> Config:
    """A JSON file; ``${NAME:-default}`` is taken from the process's environment, and a section named ``environment`` goes over the rest."""
    if not os.path.exists(path):
        raise MissingConfigError(f"no configuration at {path}")
    text = re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: os.environ.get(m[1], m[2] or ""), Path(path).read_text("utf-8"))
    try:
        values = json.loads(text)
    except ValueError as e:
        raise InvalidConfigError(str(e)) from e
    base = values.get("default", {k: v for k, v in values.items() if k not in ("development", "test", "production")})
    return check(_build(Config, _over(base, values.get(environment, {}) if environment else {})))


def _over(base: dict, top: dict) -> dict:
    return {**base, **{k: _over(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in top.items()}}


def check(config: Config) -> Config:
    s = config.search
    if not 0 <= s.alpha <= 1 or s.rrf_k < 1 or s.fusion not in ("rrf", "weighted_sum") or not 1 <= s.least_limit <= s.most_limit or config.dimensions < 1:
        raise InvalidConfigError("settings out of range", {"config": config})
    return config
