"""Importing this package registers all queries."""

from . import event_features, landing_queries, lineup_queries, log_features, name_queries, slate_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
