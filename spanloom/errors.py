"""Exceptions raised while a plan is built; data errors found at run time surface as Spark errors."""


class SpanloomError(Exception):
    """Base of all errors of this package."""


class EmptyFileError(SpanloomError):
    """A file has no records."""


class NoRowsError(SpanloomError):
    """An input of an operation that needs rows has none."""


class MissingSequenceError(SpanloomError):
    """A range refers to a sequence that the genome does not hold."""


class GenomeFileError(SpanloomError):
    """A genome file has a malformed line or a repeated name."""


class UnwrapDataError(SpanloomError):
    """A payload that must be present is missing."""


class TooFewColumnsError(SpanloomError):
    """A record has fewer columns than its format needs."""


class ColumnTypeError(SpanloomError):
    """A column cannot be read as its type."""


class UnsupportedFormatError(SpanloomError):
    """The format of a file is unknown."""


class RangeOutOfBoundsError(SpanloomError):
    """A range does not fit its sequence."""


class NoOperationError(SpanloomError):
    """An aggregation was asked for without naming an operation."""
