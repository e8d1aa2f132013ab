"""Cleaning of wide tables (F1-F3): missing values, one-hot, outlier caps.

Each statistic is one aggregate pass over all columns at once (the fit
step).  Its single result row - a few numbers per column - becomes literals,
so applying it is a plain codegen'd projection of the big table (no join).

Quantiles: ``method='exact'`` (default) selects the exact order statistics
with a few distributed rounds (``operators.quantiles``; linear
interpolation, equal to pandas) - no column is ever merged in one task.
``method='approx'`` uses ``percentile_approx`` (rank error about 1/accuracy)
in a single pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import fit_row
from .features import numeric_columns
from .quantiles import exact_quantiles, present
from .shapes import label_codes


def _quantiles(df: DataFrame, cols, qs, method: str, accuracy: int) -> dict:
    """{col: [value per q]} (the fit step)."""
    if not cols:
        return {}
    if method == "approx":
        row = fit_row(df, {c: F.percentile_approx(present(F.col(c)), list(qs), accuracy) for c in cols})
        return {c: row[c] for c in cols}
    return exact_quantiles(df, cols, qs)


def fill_missing(df: DataFrame, cols: Sequence[str] | None = None, method: str = "exact",
                 accuracy: int = 100000, text_fill: str = "unknown") -> DataFrame:
    """text columns -> 'unknown', numeric columns -> column median
    (integer columns come back as double, as pandas does after a fill)."""
    types = dict(df.dtypes)
    cols = set(cols) if cols is not None else set(df.columns)
    num = [c for c, t in df.dtypes if c in cols
           and t in ("double", "float", "bigint", "int", "smallint", "tinyint")]
    med = {c: (v[0] if v else None) for c, v in _quantiles(df, num, [0.5], method, accuracy).items()}
    proj = []
    for c in df.columns:
        if types[c] == "string" and c in cols:
            proj.append(F.coalesce(F.col(c), F.lit(text_fill)).alias(c))
        elif c in num:
            m = F.lit(med[c]).cast("double")
            # NaN is missing too; pandas turns an int column with gaps into float
            proj.append(F.coalesce(present(F.col(c)), m).cast("float" if types[c] == "float" else "double").alias(c))
        else:
            proj.append(F.col(c))
    return df.select(*proj)


def one_hot(df: DataFrame, cols: Sequence[str] | None = None, drop_first: bool = True,
            categories: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """one-hot every text column over its sorted categories, first one
    dropped, new columns ``{col}_{value}`` appended at the end (the source
    column is removed).  The result has a column per category, so their names
    must be known: from ``categories``, or by one distinct pass whose values
    become the schema.  For a column of ids use ``one_hot_sparse``, whose
    schema does not depend on the data."""
    cols = list(cols) if cols is not None else [c for c, t in df.dtypes if t == "string"]
    learn = [c for c in cols if c not in (categories or {})]
    cats = {c: sorted(v) for c, v in (categories or {}).items()} | {c: [] for c in learn}
    if learn:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("val")) for c in learn]))
        seen = df.select(pairs.alias("e")).select("e.*").where("val IS NOT NULL").distinct()
        for r in seen.orderBy("col", "val").toLocalIterator():
            cats[r["col"]].append(r["val"])
        cats = {c: sorted(v) for c, v in cats.items()}
    new = [F.when(F.col(c) == F.lit(v), 1).otherwise(0).alias(f"{c}_{v}")
           for c in cols for v in cats[c][1 if drop_first else 0:]]
    return df.select(*[x for x in df.columns if x not in cols], *new)


def one_hot_sparse(df: DataFrame, col: str, drop_first: bool = True) -> DataFrame:
    """F2 for a column with any number of categories: replace ``col`` by
    ``{col}_index``, the 0-based place of its one (NULL: none, as for a missing
    or the dropped first category), from the dense label codes joined back by
    value.  No list of categories reaches the driver."""
    coded = label_codes(df, col, f"{col}_index")
    place = F.col(f"{col}_index") - (1 if drop_first else 0)
    return coded.withColumn(f"{col}_index", F.when(place >= 0, place)).drop(col)


def cap_outliers(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5,
                 method: str = "exact", accuracy: int = 100000) -> DataFrame:
    """cap each numeric column to [Q1 - k*IQR, Q3 + k*IQR]; NaN counts as
    missing and stays missing (NULL)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    qs = _quantiles(df, cols, [0.25, 0.75], method, accuracy)
    proj = []
    for c in df.columns:
        if c in cols:
            q1, q3 = (F.lit(None).cast("double"), F.lit(None).cast("double")) if qs[c][0] is None else \
                (F.lit(float(qs[c][0])), F.lit(float(qs[c][1])))
            lo, hi = q1 - F.lit(k) * (q3 - q1), q3 + F.lit(k) * (q3 - q1)
            x = present(F.col(c))
            proj.append(F.when(x < lo, lo).when(x > hi, hi).otherwise(x).alias(c))
        else:
            proj.append(F.col(c))
    return df.select(*proj)
