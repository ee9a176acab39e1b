"""Small column-expression helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` (a one-element
    ``transform``).  Keeps expressions that reuse a value linear in size,
    also after the optimizer inlines them into pushed-down filters or
    collapsed projections."""
    return F.get(F.transform(F.array(value), fn), 0)
