"""Registered queries. Importing the modules fills the registry."""

from hinterland.catalogue import (  # noqa: F401
    aggregate_queries,
    frame_queries,
    geo_queries,
    join_queries,
    model_queries,
    panel_queries,
    posterior_queries,
    source_queries,
)
from hinterland.catalogue.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
