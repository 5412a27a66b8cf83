"""Errors, by what failed. Each carries a context for logs."""

from __future__ import annotations


class EngineError(Exception):
    prefix = ""

    def __init__(self, message: str = "", context: dict | None = None):
        super().__init__(self.prefix + message)
        self.context = context or {}


def _family(base: type[EngineError], *names: str) -> None:
    for name in names:
        globals()[name] = type(name, (base,), {"__module__": __name__})


class DocumentProcessingError(EngineError):
    pass


class SearchError(EngineError):
    prefix = "Search failed: "


class EmbeddingError(EngineError):
    pass


class TagError(EngineError):
    pass


class DatabaseError(EngineError):
    pass


class ConfigError(EngineError):
    pass


class ServiceError(EngineError):
    prefix = "Service error: "


class LLMError(EngineError):
    pass


class ParserError(EngineError):
    pass


class ValidationError(EngineError):
    pass


_family(DocumentProcessingError, "DocumentDownloadError", "DocumentConversionError", "ChunkingError")
_family(SearchError, "VectorSearchError", "QueryParseError", "LanguageDetectionError", "QueryProcessingError", "FulltextSearchError", "HybridSearchError")
_family(EmbeddingError, "EmbeddingGenerationError", "EmbeddingStorageError", "EmbeddingNotFoundError")
_family(TagError, "TagGenerationError", "TagStorageError")
_family(DatabaseError, "MigrationError", "ConnectionError")
_family(ConfigError, "InvalidConfigError", "MissingConfigError")
_family(ServiceError, "EmbeddingServiceError", "VectorSearchServiceError", "FulltextSearchServiceError", "HybridSearchServiceError", "SummarizationServiceError", "TagServiceError", "QueryProcessingServiceError", "ResponseGenerationError")
_family(LLMError, "LLMConnectionError", "LLMRateLimitError", "LLMTimeoutError", "LLMResponseError", "LLMConfigurationError", "ExternalServiceUnavailable", "ContextTooLarge")
_family(ParserError, "QueryParserError")
_family(ValidationError, "InvalidQueryError", "InvalidParameterError")
