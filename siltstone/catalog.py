"""Queries of the library's own operators and their DuckDB equivalents."""

from __future__ import annotations

from .plans import content, files, journals, large, logs, settings, streams

QUERIES = {**files.QUERIES, **content.QUERIES, **logs.QUERIES, **settings.QUERIES, **large.QUERIES, **journals.QUERIES, **streams.QUERIES}
ORACLES = {**files.ORACLES, **content.ORACLES, **logs.ORACLES, **settings.ORACLES, **large.ORACLES, **journals.ORACLES, **streams.ORACLES}
