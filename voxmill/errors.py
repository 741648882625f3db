"""Typed errors raised on the driver when an input or a run breaks its contract."""

from __future__ import annotations


class FeedbackError(ValueError):
    """Carries a stable ``code`` and machine-readable ``details`` next to the message."""

    code = "FEEDBACK_ERROR"

    def __init__(self, message: str, **details: object) -> None:
        super().__init__(message)
        self.details = details


class MissingColumn(FeedbackError):
    code = "MISSING_COLUMN"


class InvalidFile(FeedbackError):
    def __init__(self, code: str, message: str, **details: object) -> None:
        super().__init__(message, **details)
        self.code = code


class RowGateError(FeedbackError):
    def __init__(self, code: str, message: str, **details: object) -> None:
        super().__init__(message, **details)
        self.code = code


class ContractMismatch(FeedbackError):
    code = "ENGINE_CONTRACT_MISMATCH"


class NoDateData(FeedbackError):
    code = "NO_DATE_DATA"


class NotFound(FeedbackError):
    def __init__(self, code: str, message: str, **details: object) -> None:
        super().__init__(message, **details)
        self.code = code
