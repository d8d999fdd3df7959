"""Route profitability analytics as composable Spark DataFrame operators."""

from skyledger.params import DEFAULT_PARAMS, RouteParams

__all__ = ["DEFAULT_PARAMS", "RouteParams"]
