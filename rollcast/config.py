"""Options of the attribution operators."""

from __future__ import annotations

from dataclasses import dataclass

BLOCK_NULLS = ("month", "quarter", "season")
THETA_GRID = (0.0, 0.01, 0.1, 0.5, 1.0, 2.0, 4.0, 8.0)  # fixed values: the default theta search
DAILY_LAGS = {"1": 1, "7": 7, "30": 30, "365": 365, "3650": 3650}
HOURLY_LAGS = {"1": 1, "24": 24, "168": 168, "720": 720, "8760": 8760, "87600": 87600}


@dataclass(frozen=True)
class AttributionConfig:
    """window: rows of a rolling window; tp: forecast horizon in steps; replicates: null
    replicates, 0 for none; seed: of the null tables; preserve_weekly: shifts are multiples of
    7; block_null: month, quarter or season, shuffles calendar blocks and needs date_column;
    ridge: added to the null's denominator; pre_normalize_y: z-score the forecast first.

    parity=False gives one scale to the observed score and its null and compares them with a
    tolerance; parity=True keeps the raw observed score and the exact comparison."""

    window: int = 90
    tp: int = 1
    replicates: int = 0
    seed: int = 0
    preserve_weekly: bool = False
    block_null: str | None = None
    date_column: str | None = None
    ridge: float = 1e-12
    pre_normalize_y: bool = False
    parity: bool = False

    def block_mode(self) -> str | None:
        """The block null in lower case; any other value means circular shifts."""
        mode = (self.block_null or "").lower()
        if mode not in BLOCK_NULLS:
            return None
        if not self.date_column:
            raise ValueError("a block null needs date_column")
        return mode


def holdout(n: int, fraction: float = 0.2) -> int:
    """Rows held out of n: the fraction, at least 20, at most a third (or 10)."""
    return min(max(20, int(n * fraction)), max(10, n // 3))
