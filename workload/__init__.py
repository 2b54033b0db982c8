"""Registered queries: each one pairs a Spark plan with the SQL it must agree with."""

from workload import cleaning, features, ingest, learning, preparation, results, sites, spatial  # noqa: F401
from workload.core import REGISTERED

__all__ = ["REGISTERED"]
