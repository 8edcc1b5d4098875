"""Errors with the exit codes that a command ends with."""

from __future__ import annotations


class AdjudicaError(Exception):
    """Base; context is for logs."""

    exit_code = 5

    def __init__(self, message: str, context: dict | None = None):
        super().__init__(message)
        self.context = context or {}


class ConfigurationError(AdjudicaError):
    exit_code = 2


class ValidationError(ConfigurationError):
    pass


class RepositoryError(AdjudicaError):
    exit_code = 3


class AnalysisError(AdjudicaError):
    exit_code = 4


class ModelError(AdjudicaError):
    exit_code = 4
