"""All core queries and their SQL."""

from __future__ import annotations

from . import problems, ranges

QUERIES = dict(ranges.QUERIES) | dict(problems.QUERIES)
SQL = dict(ranges.SQL) | dict(problems.SQL)
