"""All query modules, imported for their registrations."""

from eligrid.plans import (  # noqa: F401
    queries_conversation,
    queries_core,
    queries_mining,
    queries_quality,
    queries_results,
    queries_sources,
    queries_streams,
)
from eligrid.plans.registry import ORACLES, QUERIES  # noqa: F401
