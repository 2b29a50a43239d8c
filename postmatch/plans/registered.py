"""Imports every module that registers queries."""

from postmatch.plans import (  # noqa: F401
    registered_funnel,
    registered_history,
    registered_matching,
    registered_operations,
    registered_run,
    registered_scoring,
    registered_sketches,
    registered_sources,
)
from postmatch.plans.registry import ORACLES, QUERIES  # noqa: F401
