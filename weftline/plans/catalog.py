"""Every query, from the modules that register them."""

from weftline.plans import joins, measures, pools, programs, ranks, reports, samples  # noqa: F401
from weftline.plans.registry import FLAGSHIP, QUERIES, SQL

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
