"""What can be wrong with a query before Spark runs it."""

from __future__ import annotations


class QueryError(Exception):
    """Any fault of a query or catalog that is found before execution."""


class QuerySyntaxError(QueryError):
    """The text isn't a query; ``line`` and ``column`` count from 1."""

    def __init__(self, line: int, column: int, message: str):
        super().__init__(f"{line}:{column}: {message}")
        self.line, self.column, self.message = line, column, message


class QueryTypeError(QueryError):
    """Names or types don't fit."""


class CatalogError(QueryError):
    """A table isn't registered, or an entry is wrong."""


class UnknownTable(CatalogError, KeyError):
    """A table isn't registered; as catalogs are mappings, it is a missing key, too."""

    __str__ = Exception.__str__  # a KeyError would quote its message
