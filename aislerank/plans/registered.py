"""Importing this module registers every query."""

from aislerank.plans import documents, finding, loading, measuring, merchandise, ranking, sessions, similarity, streams  # noqa: F401
from aislerank.plans.book import ORACLES, QUERIES  # noqa: F401
