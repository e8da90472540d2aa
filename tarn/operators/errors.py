"""What a statement can be refused for; all are ValueErrors."""

from __future__ import annotations


class TableError(ValueError):
    """A statement can't be carried out on the tables as they are."""


class NoSuchTable(TableError):
    pass


class TableExists(TableError):
    pass


class NoSuchColumn(TableError):
    pass


class ColumnExists(TableError):
    pass


class WrongArity(TableError):
    """A row has more or fewer values than columns are named."""


class WrongType(TableError):
    """A type that isn't known, or can't be used here."""


class ConstraintViolation(TableError):
    """Rows break a constraint of the table."""


class BlobPredicateError(TableError):
    """A condition reads a binary column."""
