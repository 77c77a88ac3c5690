"""Settings of an extraction, passed explicitly: executors see no globals of the driver."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """pages: ``all`` or a range like ``1,3-5``; min_score: 4 for target extraction (8 suits the all-tables mode)."""

    pages: str = "all"
    max_pages: int = 5
    min_score: float = 4.0
    dedup: bool = True
    policy: str = "focused"
    template: str = "auto"
    flatten_newlines: bool = False
    fix_superscript: bool = False

    def __post_init__(self) -> None:
        if self.policy not in ("focused", "broad"):
            raise ValueError("policy must be 'focused' or 'broad'")
