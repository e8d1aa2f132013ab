"""Array helpers for per-row series work."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` as a lambda
    variable.  Referencing a computed column inside a per-element lambda
    would otherwise be inlined by the optimizer and re-evaluated for every
    element; binding it through ``aggregate``'s finish function avoids that."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _x: acc, body)


def fit_row(df, exprs: dict):
    """Run one aggregate job and return its single row as a dict (the "fit"
    step of an estimator, as Spark ML's own scalers do).  Only a handful of
    statistics per column reach the driver, never data rows."""
    from pyspark.sql import functions as F  # noqa: F811
    row = df.agg(*[c.alias(n) for n, c in exprs.items()]).first()
    return row.asDict(recursive=True)
