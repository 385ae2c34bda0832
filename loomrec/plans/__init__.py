"""Registered queries."""

from loomrec.plans import queries, extended, stages, learned  # noqa: F401, I001  (the others register their queries in the first)
