"""All queries over the reference tables by name, with the SQL that must give the same rows."""

from . import signal_queries, timeline_queries

PARTS = [signal_queries, timeline_queries]
QUERIES = {k: v for p in PARTS for k, v in p.QUERIES.items()}
ORACLES = {k: v for p in PARTS for k, v in p.ORACLES.items()}
FLAGSHIP = "measure_levels"
