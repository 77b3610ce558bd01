"""Errors of single requests and the outcome codes of request tables."""


class TreeError(ValueError):
    code = "ERROR"


class NotFound(TreeError):
    code = "NOT_FOUND"


class NotDirectory(TreeError):
    code = "NOT_DIR"


class InvalidParameter(TreeError):
    code = "INVALID_PARAM"


class EmptyQuery(TreeError):
    code = "EMPTY_QUERY"


class IndexStale(TreeError):
    code = "CONFLICT"
