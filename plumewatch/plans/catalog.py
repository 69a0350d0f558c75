"""All registered queries."""

from plumewatch.plans import (  # noqa: F401
    asset_queries, frame_queries, score_queries, telemetry_queries)
from plumewatch.plans.registry import QUERIES, SQL  # noqa: F401
from plumewatch.plans.score_queries import flagship  # noqa: F401
