"""Structured errors: a code of the contract, a message, details and what to do."""

from __future__ import annotations

from typing import Any


class ApiError(Exception):
    def __init__(self, code: str, message: str, details: dict[str, Any] | None = None, retry_hint: str = "Correct the argument and call again.") -> None:
        super().__init__(message)
        self.code, self.message, self.details, self.retry_hint = code, message, details or {}, retry_hint

    def as_dict(self) -> dict[str, Any]:
        return {"code": self.code, "message": self.message, "details": self.details, "retry_hint": self.retry_hint}
