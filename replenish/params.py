"""Every tunable of the library in one immutable record."""

from __future__ import annotations

from dataclasses import dataclass, replace
from statistics import NormalDist


@dataclass(frozen=True)
class Params:
    # stream windows, seconds
    window_size: int = 300
    slide: int = 60
    watermark: str = "10 minutes"
    batch_size: int = 100

    # forecasting
    horizon: int = 30
    confidence: float = 0.95
    lookback: int = 14
    min_series_days: int = 14
    min_sequences: int = 50
    min_series_std: float = 0.1
    trend_weight: float = 0.3
    ar_weight: float = 0.4
    additive_weight: float = 0.3

    # replenishment
    lead_time: int = 7
    service_level: float = 0.95
    storage_capacity: float = 10000.0
    budget: float = 100000.0
    holding_cost: float = 0.5
    order_cost: float = 100.0
    shortage_cost: float = 50.0
    waste_multiplier: float = 2.0
    min_order_qty: float = 10.0
    max_order_qty: float = 1000.0
    min_order_value: float = 100.0
    max_order_value: float = 100000.0
    shortage_scenarios: int = 1000
    shortage_days: int = 30

    # policy grid
    policy_step: int = 10
    policy_max_stock: int = 1000
    policy_max_order: int = 500
    policy_discount: float = 0.95
    policy_rounds: int = 100
    policy_tolerance: float = 0.01

    # intervals by resampling
    bootstrap_rounds: int = 1000
    simulations: int = 10000

    # privacy
    epsilon: float = 1.0
    utility_threshold: float = 0.85
    privacy_threshold: float = 0.80

    # service targets
    target_fill_rate: float = 0.9995
    target_waste: float = 0.10
    target_cost_cut: float = 0.30
    max_latency_ms: float = 305.0
    min_throughput: float = 10000.0
    min_availability: float = 0.9995

    seed: int = 42

    @property
    def z(self) -> float:
        """Two-sided normal quantile of ``confidence``."""
        return NormalDist().inv_cdf((1 + self.confidence) / 2)

    def but(self, **changes) -> "Params":
        return replace(self, **changes)
