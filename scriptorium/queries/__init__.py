"""All registered queries of the course-material engine."""

from . import sources
from .course import QUERIES
from .course import SQL as ORACLE_SQL
from .course import lexical_search_batch as flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship", "sources"]
