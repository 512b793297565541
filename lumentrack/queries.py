"""Registry of the engine's queries and their SQL twins."""

from lumentrack.plans import fusion, raster, semantic, service, streams, trajectory

_PLANS = (trajectory, raster, semantic, fusion, service, streams)
QUERIES: dict = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for plan in _PLANS for name, sql in plan.ORACLE_SQL.items()}
FLAGSHIP = "fused_objects"
