"""Query modules whose QUERIES and ORACLES make up the public query set."""

from . import basics, canonical, cycle, diagnostics, evaluation, forecast, horizons, inventory, panel, reports, scalars, staging, streams, supply, windows

MODULES: list = [basics, canonical, cycle, diagnostics, evaluation, forecast, horizons, inventory, panel, reports, scalars, staging, streams, supply, windows]
