"""All registered queries; importing the modules registers them."""

from __future__ import annotations

from . import q_context, q_features, q_labels, q_metrics, q_models, q_sources, q_studies, q_tables, q_trades  # noqa: F401
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
