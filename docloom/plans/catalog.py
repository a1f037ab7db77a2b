"""The registry of this library's own queries."""

from docloom.plans import chunking, coding, crawling, enriching, evaluating, relations, remembering, searching

FLAGSHIP = "hybrid_search"
_PARTS = (chunking, searching, enriching, relations, coding, crawling, remembering, evaluating)
QUERIES = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
SQL = {k: sql for part in _PARTS for k, sql in part.SQL.items()}
