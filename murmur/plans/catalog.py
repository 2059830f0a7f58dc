"""Imports every query module so the registry is complete."""

from murmur.plans import q_experiments, q_files, q_io, q_metrics, q_models, q_phrases, q_relational, q_text, q_timeline, q_topics, q_vectors  # noqa: F401
from murmur.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
