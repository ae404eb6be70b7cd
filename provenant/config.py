"""Settings: environment-backed knobs that become literals in a plan."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields, replace
from datetime import date
from typing import Any

TRUE_WORDS = {"1", "true", "yes", "on"}


@dataclass(frozen=True)
class Settings:
    """Fixed values of the method; see :func:`from_env` for overriding them."""

    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    rrf_k: int = 60
    retrieval_top_k: int = 12
    rerank_top_k: int = 6
    min_relevance: float = 0.12
    min_support: float = 0.20
    overlap_weight: float = 0.7
    number_bonus: float = 0.2
    clause_bonus: float = 0.4
    unresolved_factor: float = 0.25
    deferral_overlap: float = 0.15
    deferral_window: int = 40
    condition_look_back: int = 80
    guard_share: float = 0.85
    guard_margin: float = 1.15
    support_margin: float = 0.7
    jaccard_min: float = 0.40
    modifier_window: int = 25
    max_clause_chars: int = 2000
    boundary: date = date(2026, 3, 1)
    default_year: int = 2026
    mid_month: int = 15
    suppressed_clause: str = "9.1.4"
    suppressing_clause: str = "4.3.2"
    apportioning_clause: str = "7.4.3"
    strict_effective: bool = False
    version_chain: bool = False
    jurisdiction: str = ""
    llm_enabled: bool = False


def _parse(kind: str, raw: str, default: Any) -> Any:
    """``raw`` as the default's type; what can't be read leaves the default."""
    readers: dict[type, Callable[[str], Any]] = {
        bool: lambda s: s.strip().lower() in TRUE_WORDS, int: int, float: float, str: str, date: date.fromisoformat,
    }
    try:
        return readers[type(default)](raw)
    except ValueError:
        return default


def from_env(env: Mapping[str, str] | None = None, prefix: str = "PROVENANT_") -> Settings:
    env = os.environ if env is None else env
    base = Settings()
    found = {f.name: env[k] for f in fields(base) if (k := prefix + f.name.upper()) in env}
    return replace(base, **{k: _parse(k, v, getattr(base, k)) for k, v in found.items()})
