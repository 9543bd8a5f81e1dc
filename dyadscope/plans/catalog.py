"""All registered queries; importing this module fills the registry."""

from dyadscope.plans import choice_queries, model_queries, result_queries, run_queries  # noqa: F401
from dyadscope.plans.registry_of_queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
