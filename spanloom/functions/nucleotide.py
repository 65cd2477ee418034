"""Base composition of nucleotide strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ambiguity letters that the loose GC share counts.
GC_LOOSE = "GCSVHDBN"


def _share(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.lit(0.0)).otherwise(F.try_divide(n.cast("double"), d))


def gc_content(seq: Column) -> Column:
    """Share of letters that are or may be G or C; 0 for an empty string, null for null."""
    return _share(F.regexp_count(F.upper(seq), F.lit(f"[{GC_LOOSE}]")), F.length(seq))


def gc_content_strict(seq: Column) -> Column:
    """G and C among A, T, G, C; 0 where none of the four occurs, null for null."""
    up = F.upper(seq)
    return _share(F.regexp_count(up, F.lit("[GC]")), F.regexp_count(up, F.lit("[ATGC]")))
