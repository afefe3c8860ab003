"""Exceptions of the engine; all derive from `StoreError`."""

from __future__ import annotations


class StoreError(Exception):
    """Base of every error that the engine raises on purpose."""


class DimensionMismatch(StoreError):
    """A vector's length is not the store's dimension."""


class MetricMismatch(StoreError):
    """A store is opened with another metric than it was made with."""


class KeyMismatch(StoreError):
    """A superseding record names another key than the record that it replaces."""


class DuplicateKey(StoreError):
    """A live record of the namespace already has the key."""


class NotFound(StoreError):
    """There is no such record."""


class FilterParse(StoreError):
    """A filter expression can't be parsed; `position` is a byte offset."""

    def __init__(self, message: str, position: int = 0) -> None:
        super().__init__(f"{message} at byte {position}")
        self.position = position


class Busy(StoreError):
    """Another writer committed first."""


class TooLarge(StoreError):
    """A key, text or metadata value is larger than its limit."""


class LimitExceeded(StoreError):
    """A parameter is beyond its limit."""


class MetaTooDeep(StoreError):
    """Metadata is nested too deeply."""


class Closed(StoreError):
    """The store is closed."""


class ReadOnly(StoreError):
    """The store was opened for reading only."""


class NonFinite(StoreError):
    """A number is NaN or infinite."""


class ConfigError(StoreError):
    """A setting is outside its range."""


class Unsupported(StoreError):
    """The operation is not available in this form."""


class Inconsistent(StoreError):
    """The store's tables contradict each other."""


class Corrupted(StoreError):
    """A commit record can't be read."""


class UnsupportedVersion(StoreError):
    """The store was written in a newer format."""


class IdExhausted(StoreError):
    """No identifiers are left."""
