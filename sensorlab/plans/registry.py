"""Registry of named queries (one per operator id) and their DuckDB oracles.

A query is ``fn(spark, sf_dir) -> DataFrame`` over the test tables.  Double
columns listed in ``dbl`` are rounded to ``digits`` on both sides, so sums
taken in a different order compare equal.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def round_cols(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Round half-even at ``digits`` decimals with plain double arithmetic
    (``rint(x * 10^d) / 10^d``; Spark's ``round`` on doubles goes through
    BigDecimal, which costs more than most queries).  "+ 0.0" turns a negative
    zero into 0.0.  ``round_sql`` is the same formula in DuckDB."""
    cs = set(cols)
    k = float(10 ** digits)
    return df.select(*[(F.rint(F.col(c) * F.lit(k)) / F.lit(k) + F.lit(0.0)).alias(c) if c in cs else F.col(c)
                       for c in df.columns])


def round_sql(sql: str, cols: Sequence[str], digits: int = 6) -> str:
    if not cols:
        return sql
    k = f"{float(10 ** digits)!r}::DOUBLE"
    rep = ", ".join(f"(round_even({c} * {k}, 0) / {k} + 0.0::DOUBLE) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS _q"


def register(name: str, sql: str | None = None, dbl: Sequence[str] = (), digits: int = 6):
    """Decorator: register ``fn`` under ``name`` with an optional oracle."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_cols(fn(spark, sf_dir), dbl, digits)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = round_sql(sql.strip(), dbl, digits)
        return fn
    return deco


def load_all() -> None:
    """Import every query module so their registrations run."""
    from . import (  # noqa: F401
        q_augment,
        q_board,
        q_dtw,
        q_metrics,
        q_misc,
        q_series,
        q_shapes,
        q_spectral,
        q_tabular,
    )
