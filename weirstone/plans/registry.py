"""All queries of the core, with their SQL."""

from weirstone.plans import accounts, core, modelling, monthly, overall, publishing, research, selection, threads

_PARTS = [accounts.query, monthly.query, research.query, modelling.query, threads.query, overall.query, publishing.query, selection.query]
QUERIES, SQL = {**core.QUERIES}, {**core.SQL}
for _p in _PARTS:
    QUERIES |= _p.queries
    SQL |= _p.sql
FLAGSHIP = publishing.prevalence_pinned
