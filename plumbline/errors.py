"""The refusals a caller can get back, each with a stable code."""

from __future__ import annotations


class PlumblineError(Exception):
    """Base class; ``code`` is what an audit row records."""

    code = "INTERNAL"


class ValidationError(PlumblineError):
    code = "VALIDATION"


class LimitExceededError(PlumblineError):
    code = "IMPORT_LIMIT_EXCEEDED"


class NotFoundError(PlumblineError):
    code = "NOT_FOUND"


class SchemaIncompatibleError(PlumblineError):
    """The query no longer fits the dataset; ``issues`` lists every reason at once."""

    code = "SCHEMA_INCOMPATIBLE"

    def __init__(self, issues):
        self.issues = tuple(issues)
        super().__init__(" ".join(issue.message for issue in self.issues))


def error_code(error: BaseException) -> str:
    return error.code if isinstance(error, PlumblineError) else "INTERNAL"
