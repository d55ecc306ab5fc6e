"""All registered queries."""

from khata.plans import corpus_queries, file_queries, form_queries, message_queries, model_queries, report_queries  # noqa: F401
from khata.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
