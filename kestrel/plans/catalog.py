"""Imports every query module so their queries register."""

from kestrel.plans import q_clean, q_missing, q_models, q_profile, q_tests  # noqa: F401
from kestrel.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
