"""The relational surface: one registered query for each construct, with independent DuckDB SQL."""

from . import aggregates, expressions, joins, nested, scans, sets, windows

MODULES = (scans, expressions, joins, aggregates, windows, sets, nested)
