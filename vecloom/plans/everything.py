"""Importing this module registers all queries."""

from vecloom.plans import feeds, measures, reads, shapes, vectors  # noqa: F401

FLAGSHIP = "score_velocity"
