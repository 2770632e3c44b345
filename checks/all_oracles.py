"""All oracle SQL, keyed like the queries."""

from checks import oracles, oracles_reports  # noqa: F401  (registration)
from checks.oracles import ORACLES

__all__ = ["ORACLES"]
