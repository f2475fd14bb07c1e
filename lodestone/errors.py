"""The one error type of the engine."""

from __future__ import annotations


class EngineError(ValueError):
    """A refused request; ``status`` follows HTTP: 400 bad input, 404 no such row, 409 conflict."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def refuse(message: str, status: int = 400):
    raise EngineError(status, message)
