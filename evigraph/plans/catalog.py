"""All registered queries."""

from . import q_actions, q_audit, q_docs, q_graph, q_rank, q_records, q_replay, q_retrieve, q_stream  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
