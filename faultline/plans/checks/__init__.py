"""Every operator as a query over the TPC-H-like tables, each next to its SQL oracle."""

from faultline.plans.checks import (  # noqa: F401
    catalog,
    compare,
    ingest,
    profile,
    recalls,
    search,
    taxonomy,
    updates,
)
from faultline.plans.checks.registry import oracles, queries  # noqa: F401
