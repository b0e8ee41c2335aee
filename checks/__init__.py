"""Runnable queries over the driver's tables, each with the SQL that must give the same rows."""

from checks.registry import REGISTRY, Check
from checks import (  # noqa: F401  (imported for their registrations)
    chunk_checks,
    exchange_checks,
    generate_checks,
    join_checks,
    layout_checks,
    near_checks,
    review_checks,
    scalar_checks,
    selection_checks,
    source_checks,
    table_checks,
)

__all__ = ["REGISTRY", "Check"]
