"""What can go wrong, each kind with a code that callers can tell it by."""

from __future__ import annotations


class QuarryError(Exception):
    """``message`` is for people, ``details`` for logs."""

    code = "QUARRY_ERROR"

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.message, self.details = message, details

    def to_dict(self) -> dict:
        return {"error_code": self.code, "message": self.message, "details": self.details}


class StoreError(QuarryError):
    """The index can't be read or written."""

    code = "STORE_ERROR"


class FileAccessError(QuarryError):
    """The source tree, or a file of it, can't be read."""

    code = "FILE_ACCESS_ERROR"


class IndexingError(QuarryError):
    """A repository was found but could not be indexed."""

    code = "INDEXING_ERROR"


class DimensionError(QuarryError, ValueError):
    """A vector is not of the index's length."""

    code = "DIMENSION_ERROR"
