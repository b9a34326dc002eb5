"""The one exception that statements raise."""

from __future__ import annotations

# The stable error codes.
CODES = (
    "SYNTAX_ERROR", "UNKNOWN_TABLE", "UNKNOWN_COLUMN", "TYPE_MISMATCH", "DUPLICATE_KEY", "NOT_NULL_VIOLATION",
    "STORAGE_FULL", "TXN_ABORTED", "READ_ONLY_TXN", "TXN_ALREADY_OPEN", "SCHEMA_CHANGE_IN_TXN", "LOCK_TIMEOUT",
    "CANCELLED", "TOO_MANY_CONNECTIONS", "DATABASE_EXISTS", "TABLE_EXISTS", "DATABASE_IN_USE", "UNKNOWN_DATABASE",
)


class DbError(Exception):
    def __init__(self, code: str, message: str, position: int | None = None):
        assert code in CODES, code
        super().__init__(f"{code}: {message}" + (f" at character {position}" if position else ""))
        self.code, self.message, self.position = code, message, position
