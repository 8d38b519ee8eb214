"""Settings of a reconciliation run."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Settings:
    """What decides results; memory, threads and spilling are Spark's own settings."""

    suffix_a: str = "_a.csv"
    suffix_b: str = "_b.csv"
    sides: tuple[str, str] = ("A", "B")
    format_overrides: dict[str, dict[str, dict[str, str]]] = field(default_factory=dict)
    max_line_bytes: int = 2 * 1024 * 1024
    reject_limit_percent: float = 1.0
    key_mode: str = "auto"
    key_overrides: dict[str, list[str] | None] = field(default_factory=dict)
    key_min_overlap: float = 0.80
    key_max_columns: int = 3
    key_candidates: int = 5
    key_hints: tuple[str, ...] = ("ID", "KEY", "NO", "NUM", "CODE")
    example_values: int = 3
    sample_rows: int = 100_000
    quote_values: bool = True
    disk_factor: float = 4.0
