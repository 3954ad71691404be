"""All registered queries of this subpackage and the SQL of those that SQL can express."""

from . import queries_scan, queries_text

MODULES = (queries_text, queries_scan)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
