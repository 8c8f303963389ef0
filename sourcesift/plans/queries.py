"""All registered queries."""

from sourcesift.plans import extracts, flows, graphs, reports, scans  # noqa: F401
from sourcesift.plans.registry import ORACLES, QUERIES  # noqa: F401
