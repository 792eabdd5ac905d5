"""Every registered query of the engine, by name, and its SQL where SQL can say it."""

from __future__ import annotations

from draper.plans import checks, configured, descriptions, evaluation, files, learning, outfits, parsing, perception, scalars  # noqa: F401  they register their queries
from draper.plans.registry import QUERIES as _REGISTRY

QUERIES = _REGISTRY.made
ORACLE = _REGISTRY.sql
