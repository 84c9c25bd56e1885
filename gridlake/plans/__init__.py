"""Registered queries and the views they run on."""

from . import q_analytics, q_functions, q_models, q_quality, q_recommend, q_sources, q_status, q_tables  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
