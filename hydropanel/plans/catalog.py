"""All registered queries."""

from hydropanel.plans import (  # noqa: F401
    q_aggregates,
    q_catchment,
    q_functions,
    q_joins,
    q_regions,
    q_regression,
    q_reshape,
    q_rows,
    q_sources,
    q_spatial,
    q_windows,
)
from hydropanel.plans.registry import ORACLES, QUERIES  # noqa: F401
