"""Parameters of a scan. Windows are counted in slots, so that any bar width can be evaluated."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class GateParams:
    """What a rolling window of bars must reach."""

    window: int = 60
    short_window: int = 5
    min_price: float = 0.25
    min_present: int = 45
    max_gap: int = 3
    min_trades: float = 1000.0
    min_short_trades: float = 100.0
    min_dollar_volume: float = 250_000.0
    max_concentration: float = 0.50


@dataclass(frozen=True)
class ScanParams:
    """One evaluation: session [start, end) in slots, thresholds and horizons."""

    start: int
    end: int
    slot_seconds: int = 1
    gate: GateParams = GateParams()
    activity_window: int = 30
    activity_stride: int = 5
    activity_references: int = 55
    move_window: int = 30
    correction_seconds: int = 960
    delay_seconds: int = 4
    top: int = 20

    @property
    def activity_span(self) -> int:
        return self.activity_window + self.activity_stride * self.activity_references + (self.activity_window - self.activity_stride)
