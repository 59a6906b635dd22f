"""Scans and sinks."""

from hydropanel.sources.scans import (  # noqa: F401
    annual_flow,
    daily_flow,
    grid_cells,
    monthly_flow,
    polygons,
    read_table,
    station_meta,
)
from hydropanel.sources.sinks import checkpoint_table, flatten_export, write_csv, write_table  # noqa: F401
