from lakemoor.plans import (  # noqa: F401  (importing registers the queries)
    aggregates,
    catalog,
    changes,
    joins,
    scalars,
    scans,
    sets,
    streams,
    udfs,
    values,
    windows,
)
from lakemoor.plans.registry import QUERIES, Mounted, Query, open_lake, run

__all__ = ["QUERIES", "Mounted", "Query", "open_lake", "run"]
