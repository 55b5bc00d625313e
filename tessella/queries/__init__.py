"""The engine's queries by name, and their SQL."""

from . import raster, records, series, spatial, workflows

MODULES = (raster, records, series, spatial, workflows)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
