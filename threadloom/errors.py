"""Errors with a code and an HTTP-like status."""

from __future__ import annotations


class EngineError(Exception):
    """What a caller of the API sees: a message, a stable code and a status."""

    def __init__(self, message: str, code: str, status: int = 500) -> None:
        super().__init__(message)
        self.code, self.status = code, status


def ingestion_failed(cause: Exception) -> EngineError:
    return EngineError(f"ingestion failed: {cause}", "INGESTION_FAILED", 400)


def keyword_error(cause: Exception) -> EngineError:
    return EngineError(f"keyword extraction failed: {cause}", "KEYWORD_EXTRACTION_ERROR", 500)
