"""Queries on the driver's tables, one or more for each operator: {name: (callable, DuckDB SQL or None)}."""

from quern.queries import aggregates, joins, learning, scalars

ALL = scalars.QUERIES | joins.QUERIES | aggregates.QUERIES | learning.QUERIES
