"""Errors of the library."""


class PageError(Exception):
    """Any of them."""


class MissingDependencyError(PageError):
    """A backend is asked for that is not installed."""


class SourceNotFoundError(PageError):
    """A file does not exist."""


class InvalidParameterError(PageError):
    """A parameter is out of range."""
