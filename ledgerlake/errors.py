"""Failures a run can stop on. Each carries what a caller needs to report it."""

from __future__ import annotations


class SalesRunError(Exception):
    """Base of every failure raised on purpose."""


class BadRunDate(SalesRunError, ValueError):
    """The run date is not an ISO date."""


class MissingInput(SalesRunError):
    """A batch that should have been there is not."""


class MissingColumns(SalesRunError):
    """A raw file lacks required columns."""

    def __init__(self, message: str, columns: list[str]):
        super().__init__(f"{message}: {columns}")
        self.columns = columns


class ValidationError(SalesRunError):
    """An ingest rule failed; only the first one is named."""

    def __init__(self, rule: str, message: str, violations: int):
        super().__init__(message)
        self.rule = rule
        self.violations = violations


class SchemaMismatch(SalesRunError):
    """A table does not have the columns its contract promises."""


class EmptyBatch(SalesRunError):
    """A day holds no row that belongs to it."""


class DataQualityError(SalesRunError):
    """One or more data-quality rules failed; `failures` lists all of them."""

    def __init__(self, failures: list[tuple[str, str, int]]):
        super().__init__("; ".join(message for _, message, _ in failures))
        self.failures = failures


class EmptyPublish(SalesRunError):
    """There is nothing to publish."""


class PublishMismatch(SalesRunError):
    """The target does not hold as many rows as were sent."""
