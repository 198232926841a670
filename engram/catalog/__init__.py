"""Queries over the supplied tables, one or more per operator."""

from engram.catalog import facts, graph, streams, text  # noqa: F401
from engram.catalog.registry import QUERIES, SQL  # noqa: F401
