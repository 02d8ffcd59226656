"""All queries of the core and the SQL of those that SQL can express."""

from __future__ import annotations

from tidemark.plans import analytics, everyday, filings, market, problems, valuation

FLAGSHIP = "indicator_table"
QUERIES = {**market.QUERIES, **analytics.QUERIES, **everyday.QUERIES, **filings.QUERIES, **valuation.QUERIES, **problems.QUERIES}
SQL = {**market.SQL, **analytics.SQL, **everyday.SQL, **filings.SQL, **valuation.SQL, **problems.SQL}
