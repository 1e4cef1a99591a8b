"""Registered queries and their oracles."""

from __future__ import annotations

from tracemill.plans import alignment, choices, folds, gates, graphs, places, poses, ranks, readers, sequences, streams, texts  # noqa: F401  each registers its queries
from tracemill.plans.tables import CATALOG, ORACLES


def entry(spark, sf_dir):
    return CATALOG["g03_match_topk"](spark, sf_dir)


def queries() -> dict:
    return dict(CATALOG)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
