"""Registry of the library's queries and their SQL twins."""

from __future__ import annotations

from corpuscope.plans.oracles import ORACLES
from corpuscope.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
