"""Registered queries over the given tables, with the SQL that must give the same rows."""

from runlens.plans import files, linear, progress, samples, streams, telemetry  # noqa: F401
from runlens.plans.registry import QUERIES, SQL  # noqa: F401
