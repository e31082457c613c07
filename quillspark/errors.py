"""Errors of the engine: a code that callers can rely on, a message, and the status a server would give."""

from __future__ import annotations

STATUS = {
    "invalid_request": 400, "invalid_glob": 400, "invalid_regex": 400, "invalid_prefix": 400, "invalid_query": 400, "invalid_path": 400, "invalid_vault_name": 400,
    "vault_not_found": 404, "path_not_found": 404, "vault_not_active": 409, "vault_exists": 409, "conflict": 409, "vault_search_failed": 500, "embedding_unavailable": 503, "schema_too_new": 500,
}


class EngineError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.status = code, message, STATUS[code]
