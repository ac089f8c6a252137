"""Errors that a caller may show, with details that it should not."""


class QueryError(ValueError):
    """``secret`` holds details for logs only."""

    def __init__(self, message: str, secret: str | None = None):
        super().__init__(message)
        self.secret = secret
