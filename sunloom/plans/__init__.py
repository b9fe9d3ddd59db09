"""Registered queries by area; importing the package fills the registry."""

from sunloom.plans import cleaning, fleet, learning, live, tables, telemetry, texts  # noqa: F401
from sunloom.plans.registry import ORACLES, PLANS

__all__ = ["ORACLES", "PLANS"]
