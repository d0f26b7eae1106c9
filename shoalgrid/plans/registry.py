"""Queries of the library and their SQL, by name."""

from __future__ import annotations

from shoalgrid.plans import frame_queries, table_queries, terrain_queries

QUERIES = {**terrain_queries.QUERIES, **table_queries.QUERIES, **frame_queries.QUERIES}
SQL = {**terrain_queries.SQL, **table_queries.SQL, **frame_queries.SQL}
FLAGSHIP = "habitat_histogram"
