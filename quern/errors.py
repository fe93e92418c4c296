"""Errors of this library beside those of pyspark.errors."""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException, PySparkException

__all__ = [
    "AnalysisException",
    "CommitConflictError",
    "NoSuchNamespaceError",
    "NoSuchTableError",
    "ParseException",
    "PySparkException",
    "QuernError",
    "TableExistsError",
    "UnsupportedFeatureError",
]


class QuernError(Exception):
    """Base of this library's errors."""


class UnsupportedFeatureError(QuernError):
    """Something is refused on purpose; `owner` says what would do it."""

    def __init__(self, feature: str, owner: str = "") -> None:
        super().__init__(f"{feature} is not supported" + (f"; use {owner}" if owner else ""))
        self.feature, self.owner = feature, owner


class NoSuchTableError(QuernError):
    """A table that was named doesn't exist."""


class NoSuchNamespaceError(QuernError):
    """A namespace that was named doesn't exist."""


class TableExistsError(QuernError):
    """A table that was to be new is there already."""


class CommitConflictError(QuernError):
    """Another writer committed first."""
