"""spanloom: interval analytics on Spark DataFrames.

Ranges are rows ``(seqname, range_start, range_end, ...)`` with 0-based,
right-exclusive coordinates.  Every operator is a DataFrame rewrite; nothing is
collected except tables whose size is bounded and checked.
"""

from .errors import (
    ColumnTypeError,
    EmptyFileError,
    GenomeFileError,
    MissingSequenceError,
    NoOperationError,
    NoRowsError,
    RangeOutOfBoundsError,
    SpanloomError,
    TooFewColumnsError,
    UnsupportedFormatError,
    UnwrapDataError,
)
from .model import END, SEQ, START, RangeFrame

__all__ = [
    "END",
    "SEQ",
    "START",
    "ColumnTypeError",
    "EmptyFileError",
    "GenomeFileError",
    "MissingSequenceError",
    "NoOperationError",
    "NoRowsError",
    "RangeFrame",
    "RangeOutOfBoundsError",
    "SpanloomError",
    "TooFewColumnsError",
    "UnsupportedFormatError",
    "UnwrapDataError",
]
