"""Importing this module registers every named query."""

from reelhouse.plans import enrich, imports, maintenance, pages, stored, views  # noqa: F401
