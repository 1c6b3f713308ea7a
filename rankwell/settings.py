"""The parameters of a run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    top_n: int = 25
    floor: float = 90.0
    remote_bonus: float = 0.02
    per_company: int = 3
    least_body: int = 300
    confidence: float = 0.7
    lookback_days: int = 14
    same_role_days: int = 7
    embed_batch: int = 16
    zone: str = "Europe/Podgorica"
    fold_company: bool = True
