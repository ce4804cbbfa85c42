"""A PySpark query layer over a lakehouse of named tables."""

from lakemoor.session import build_session
from lakemoor.sources.catalog import Lake

__all__ = ["Lake", "build_session"]
