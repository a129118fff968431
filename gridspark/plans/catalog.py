"""All named queries: importing the modules below registers them."""

from __future__ import annotations

from gridspark.plans import (  # noqa: F401
    aggregate_queries,
    attach_queries,
    clean_queries,
    evaluation_queries,
    feed_queries,
    football_queries,
    form_queries,
    grading_queries,
    ingest_queries,
    join_queries,
    player_queries,
    prop_queries,
    report_queries,
    scalar_queries,
    state_queries,
    stream_queries,
    support_queries,
)
from gridspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
