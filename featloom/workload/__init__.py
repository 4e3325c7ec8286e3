"""Registered queries over the given tables, each with an independent SQL form."""

from featloom.workload import (  # noqa: F401
    compare,
    contrastive,
    encode,
    pooling,
    prep,
    runlog,
    series,
    tables,
    vectors,
)
from featloom.workload.registry import REGISTRY

__all__ = ["REGISTRY"]
