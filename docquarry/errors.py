"""Exceptions of docquarry."""

from __future__ import annotations


class QuarryError(Exception):
    """Base of all."""


class DatabaseError(QuarryError):
    pass


class FileHandlingError(QuarryError):
    pass


class ParsingError(FileHandlingError):
    pass


class ConfigurationError(QuarryError):
    pass


class VectorizationError(QuarryError):
    pass


class QueryError(QuarryError):
    pass


class ConcurrencyError(QuarryError):
    pass


class EncryptionError(QuarryError):
    pass


class GraphError(QuarryError):
    pass


class GraphDBError(DatabaseError, GraphError):
    pass


class NodeNotFoundError(GraphError):
    pass


class RelationshipNotFoundError(GraphError):
    pass


class LLMCallbackError(GraphError):
    pass


class PageNotFoundError(QuarryError):
    pass
