"""Errors a caller can act on."""


class EngineError(Exception):
    """Base class of everything raised on purpose by this package."""


class InvalidRequestError(EngineError, ValueError):
    """An argument has no meaning for the operation."""


class UnknownSourceError(EngineError, LookupError):
    """A dataset name is not in the catalogue."""


class ScopeViolationError(EngineError, PermissionError):
    """A request would read outside the catalogue."""


class UnknownColumnError(InvalidRequestError):
    """A column path does not resolve against the dataset's schema."""


class StatisticsMissingError(EngineError):
    """The file footers lack the statistics the answer would come from."""


class CapabilityUnavailableError(EngineError):
    """An optional package is not installed."""


class QueryTimeoutError(EngineError, TimeoutError):
    """A query ran past its time ceiling and was cancelled."""


class StagingError(EngineError):
    """There is no shared folder to write intermediate tables to."""
