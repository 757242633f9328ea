"""Array helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def once(value: Column, body) -> Column:
    """``body(value)``, the value computed once for each row: an expression inside a lambda is computed for each element."""
    return F.transform(F.array(value), body)[0]
