"""The registered queries of this subpackage, each next to its operator."""

from __future__ import annotations

from lakemoor.llm import (  # noqa: F401  (importing registers the queries)
    bpe,
    frames,
    lexical,
    license_scan,
    metric_tree,
    packing,
    periodic,
    permutation,
    quality,
    secret_scan,
    similar,
    unigram,
    wrapper,
)
from lakemoor.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
