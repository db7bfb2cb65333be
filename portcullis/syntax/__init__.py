"""Error-tolerant syntax trees of nine languages, and pattern queries on them."""

from portcullis.syntax.parser import parse, parse_parts
from portcullis.syntax.query import Query, QueryError

__all__ = ["Query", "QueryError", "parse", "parse_parts"]
