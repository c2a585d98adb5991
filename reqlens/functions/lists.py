"""Index lists stored as text (F2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_index_list(text: Column) -> Column:
    """Parse ``[1, 2, 3]`` into ``ARRAY<BIGINT>``; anything else is NULL."""
    return F.from_json(text, "array<bigint>")


def format_index_list(arr: Column) -> Column:
    """The inverse: an index array as list text (CSV variant of K6)."""
    return F.to_json(arr)
