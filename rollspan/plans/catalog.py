"""All registered queries, gathered by import."""

from rollspan.plans import (  # noqa: F401
    forecast_queries,
    series_queries,
    source_queries,
    window_queries,
)
from rollspan.plans.registry import ORACLES, QUERIES  # noqa: F401
