"""All registered queries."""

from trialweave.plans import queries_basic, queries_effects, queries_lookups, queries_study  # noqa: F401
from trialweave.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
