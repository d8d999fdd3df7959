"""Business constants of the route model, as one immutable parameter object."""

from __future__ import annotations

from dataclasses import dataclass

# Airport size labels.
MEDIUM = "medium_airport"
LARGE = "large_airport"


@dataclass(frozen=True)
class RouteParams:
    """Assumptions behind revenue, cost and break-even figures (USD, miles, minutes)."""

    # The published default assumptions.
    airplane_cost: float = 90_000_000.0
    operating_cost_per_mile: float = 8.00
    ownership_cost_per_mile: float = 1.18
    medium_airport_fee: float = 5_000.0
    other_airport_fee: float = 10_000.0
    delay_cost_per_minute: float = 75.0
    free_delay_minutes: float = 15.0
    seats_per_flight: float = 200.0
    bag_fee_one_way: float = 35.0
    bag_share: float = 0.5

    @property
    def cost_per_mile(self) -> float:
        return self.operating_cost_per_mile + self.ownership_cost_per_mile

    @property
    def bag_fee_round_trip(self) -> float:
        return 2 * self.bag_fee_one_way


@dataclass(frozen=True)
class SweetSpot:
    """Thresholds a city pair must meet to be worth a first look (all inclusive)."""

    # The published default thresholds.
    min_profit: float = 10_000_000.0
    max_delay: float = 5.0
    min_passengers: float = 50_000.0


DEFAULT_PARAMS = RouteParams()
DEFAULT_SWEET_SPOT = SweetSpot()
