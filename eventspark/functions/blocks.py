"""Rows that carry the number of their block of settings, so that one plan serves all blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Column with the number of a row's block; rows of no block have a number beyond the last one.
BLOCK = "__block"


def by_block(values: list[Column], rest: Column) -> Column:
    """``values[i]`` in the rows of block i, ``rest`` in those of no block."""
    for i, v in enumerate(values):
        rest = F.when(F.col(BLOCK) == i, v).otherwise(rest)
    return rest
