"""Concordat: table reconciliation expressed as Spark jobs."""

from concordat.config import Comparison, Margin, Rule, Samples, Statistics, Tolerances, Totals
from concordat.plans.validate import Report, validate

__all__ = ["Comparison", "Margin", "Report", "Rule", "Samples", "Statistics", "Tolerances", "Totals", "validate"]
