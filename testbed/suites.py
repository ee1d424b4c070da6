"""All registered queries."""

from testbed import suite_ml, suite_ops, suite_reports, suite_sources, suite_text  # noqa: F401
from testbed.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
