"""Every operator as a query over the given tables, beside the SQL it must agree with."""

from . import cells, charts, files, metadata, privacy, questions
from .questions import structured_flagship

_PARTS = (questions, cells, files, metadata, charts, privacy)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}

__all__ = ["ORACLES", "QUERIES", "structured_flagship"]
