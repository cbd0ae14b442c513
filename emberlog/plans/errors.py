"""The one error raised for a request that is itself wrong."""


class InvalidQueryError(ValueError):
    """The caller's parameters are invalid; Spark failures pass through unchanged."""
