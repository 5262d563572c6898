"""Errors, in the words that callers match on."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors of the engine."""


class TableNotFound(EngineError):
    def __init__(self, name: str) -> None:
        super().__init__(f"table not found: {name}")


class InvalidSchema(EngineError):
    def __init__(self, what: str) -> None:
        super().__init__(f"invalid schema: {what}")


class QueryError(EngineError):
    def __init__(self, what: str) -> None:
        super().__init__(f"query error: {what}")


class StorageError(EngineError):
    def __init__(self, what: str) -> None:
        super().__init__(f"storage error: {what}")


class AuthError(EngineError):
    def __init__(self, what: str) -> None:
        super().__init__(f"unauthenticated: {what}")


class StreamError(EngineError):
    def __init__(self, what: str) -> None:
        super().__init__(f"stream error: {what}")


class TransientSinkError(StreamError):
    """The commit may succeed when tried again."""


class FatalSinkError(StreamError):
    """Trying again cannot help: the stream fails."""
