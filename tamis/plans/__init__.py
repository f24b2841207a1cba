"""Every registered query; importing the modules fills the registry."""

from tamis.plans import bayes, enrichment, features, models, texts  # noqa: F401
from tamis.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
