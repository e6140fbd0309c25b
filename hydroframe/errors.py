"""Errors and warnings.  Shape and latitude problems are ValueErrors, bad arguments are not."""

from __future__ import annotations


class HydroError(Exception):
    """Base of all errors of this library."""


class FittingError(HydroError):
    """A distribution could not be fitted."""


class NotEnoughData(FittingError):
    def __init__(self, message: str, found: int | None = None, needed: int | None = None):
        super().__init__(message)
        self.found, self.needed = found, needed


class CoordinateError(HydroError):
    """A needed key or time column is missing, or nothing is left after aligning."""


class InputTypeError(HydroError, TypeError):
    """Not a DataFrame, or a column of a wrong type."""


class InvalidArgument(HydroError):
    def __init__(self, message: str, argument: str = "", value: object = None, valid: str = ""):
        super().__init__(message)
        self.argument, self.value, self.valid = argument, value, valid


class PeriodicityError(InvalidArgument):
    """The steps are neither monthly nor daily."""


class ShapeError(HydroError, ValueError):
    """A series that is too short, or inputs of unequal length."""


class IndexWarning(UserWarning):
    """Base of all warnings; they come from diagnostics only, which is a query of its own."""


class MissingDataWarning(IndexWarning):
    """More than a fifth of the calibration period is missing."""


class ShortCalibrationWarning(IndexWarning):
    """Fewer than 30 years of calibration."""


class PoorFitWarning(IndexWarning):
    """The fitted distribution differs from the data (Kolmogorov-Smirnov)."""


class AlignmentWarning(IndexWarning):
    """Rows without a partner were dropped."""


class OldNameWarning(IndexWarning, DeprecationWarning):
    """An old parameter name was used."""
