"""All registered queries of the engine with their SQL counterparts."""

from ratingmill.plans import invariants, learning, places, roundtrips, streams, summaries  # noqa: F401  (they register their queries)
from ratingmill.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
