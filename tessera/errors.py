"""The one error type of the engine, with the codes callers can test for."""

from __future__ import annotations

#: The error codes of the query language.
CODES = (
    "CONFLICT", "FK_VIOLATION", "NOT_FOUND", "CASCADE_CYCLE", "INVALID_QUERY", "DEPTH_EXCEEDED", "VERSION_COLUMN_WRITE", "CAS_EXHAUSTED",
    "ENC_CONFIG_MISSING", "ENC_KEY_INVALID", "ENC_NOT_ENCRYPTED", "ENC_DECRYPT_FAILED", "ENC_FIELD_FILTER", "ENC_FIELD_SORT", "ENC_FIELD_AGG", "ENC_FIELD_PATCH_OP",
    "GEO_INDEX_MISSING", "GEO_NOT_SUPPORTED", "FILTER_TYPE_MISMATCH",
)


class QueryError(Exception):
    """An invalid query or write: a code and, for each offending path, what is wrong."""

    def __init__(self, code: str, message: str, path: str = ""):
        if code not in CODES:
            raise ValueError(f"unknown error code {code}")
        super().__init__(f"{code}: {message}" + f" (at {path})" * bool(path))
        self.code, self.path, self.message = code, path, message
        self.errors = [{"path": path, "message": message}]
