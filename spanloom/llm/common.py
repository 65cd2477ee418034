"""Shared helpers of the text operators."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits after lower-casing; none for null."""
    return WORD.findall(text.lower()) if text else []


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of a column of texts, one after the other, and the row of each; the same words as ``words`` gives.

    Two letters whose lower case depends on where they stand are left to Python, everything else is done in bulk.
    """
    odd = pc.fill_null(pc.match_substring_regex(texts, "[\u0130\u03a3]"), False)
    if pc.any(odd, min_count=0).as_py():
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        texts = pc.replace_with_mask(texts, odd, pa.array([" ".join(words(texts[int(i)].as_py())) for i in at], texts.type))
    parts = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " "))
    rows, flat = pc.list_parent_indices(parts), pc.list_flatten(parts)
    some = pc.greater(pc.binary_length(flat), 0)
    return pc.filter(flat, some), pc.filter(rows, some).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(column: pa.Array, most_bytes: int = 8 << 20) -> list[pa.Array]:
    """A column of texts in slices of at most ``most_bytes``, a longer text by itself."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, at, done = [], 0, 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(size, done + most_bytes, "right")))
        out.append(column.slice(at, end - at))
        at, done = end, int(size[end - 1])
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows spread over all cores where the input has fewer splits than cores, so that Python stages use them all;
    a larger input stays as it is and is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(3 * cores, *keys) if df.rdd.getNumPartitions() < cores else df
