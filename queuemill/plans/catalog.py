"""All registered queries."""

from queuemill.plans.registry import CHECKS, QUERIES
from queuemill.plans import (  # noqa: F401
    decision_queries, lifecycle_queries, model_queries, retrieval_queries, score_queries, screening_queries, source_queries)

__all__ = ["QUERIES", "CHECKS"]
