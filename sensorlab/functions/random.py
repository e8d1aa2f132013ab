"""Reproducible random numbers as column expressions.

Values are derived from ``md5(seed|part|part...)`` so they are the same on
every run, every partitioning and every executor retry, and can be repeated
outside Spark (DuckDB: ``(('0x'||substr(md5(k),1,8))::BIGINT+0.5)/4294967296``).
Never ``rand()``: it depends on partition layout and changes on task retry.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(seed, *parts) -> Column:
    cols = [F.lit(str(seed))] + [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def uniform(seed, *parts) -> Column:
    """Uniform in (0, 1) from the first 32 bits of md5 of the key."""
    h = F.conv(F.substring(F.md5(_key(seed, *parts)), 1, 8), 16, 10).cast("double")
    return (h + F.lit(0.5)) / F.lit(4294967296.0)


def normal(seed, *parts, mean: float = 0.0, sigma: float = 1.0) -> Column:
    """Normal by Box-Muller from two independent hash-uniforms."""
    u1 = uniform(seed, *parts, "u1")
    u2 = uniform(seed, *parts, "u2")
    z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    return F.lit(float(mean)) + F.lit(float(sigma)) * z


def sql_uniform(seed, *parts: str) -> str:
    """DuckDB text of :func:`uniform`; ``parts`` are SQL expressions."""
    key = " || '|' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"((('0x' || substr(md5({key}), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


def sql_normal(seed, *parts: str, mean: float = 0.0, sigma: float = 1.0) -> str:
    u1 = sql_uniform(seed, *parts, "'u1'")
    u2 = sql_uniform(seed, *parts, "'u2'")
    return f"({float(mean)!r} + {float(sigma)!r} * (sqrt(-2.0 * ln({u1})) * cos({2.0 * math.pi!r} * {u2})))"
