"""Registered queries: every operator over whole tables, with equivalent SQL where there is any."""

from dataproof.queries import charts, evidence, profile, research, selects, sources  # noqa: F401
from dataproof.queries.registry import REGISTRY

__all__ = ["REGISTRY"]
