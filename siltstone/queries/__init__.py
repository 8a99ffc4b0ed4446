"""Registered queries: each pairs a Spark query with the DuckDB SQL of the same result."""

from siltstone.queries import aggregates, algebra, index, kv, scalars, sinks, statistics, timed, versions, windows  # noqa: F401
