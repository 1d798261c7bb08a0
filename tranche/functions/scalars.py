"""Column expressions for raw tokens and loan attributes; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a floating-point token; Spark's cast alone also takes 1.0f and 1d.
DOUBLE = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf|infinity)$"


def clean(token: Column) -> Column:
    """Trimmed token; empty is null."""
    return F.nullif(F.trim(token), F.lit(""))


def typed(token: Column, kind: str) -> Column:
    """Value of a raw token; null if empty or not of that kind."""
    t = clean(token)
    if kind == "text":
        return t
    if kind == "double":
        return F.when(t.rlike(DOUBLE), t.try_cast("double"))
    if kind == "int":
        return t.try_cast("int")
    return F.try_to_date(t, {"month": "M/yyyy", "day": "M/d/yyyy"}[kind])


def delinquency_months(status: Column) -> Column:
    """Months past due; X (unknown) and empty are null."""
    t = F.trim(status)
    return F.when(F.upper(t).isin("X", ""), F.lit(None)).otherwise(t.try_cast("int")).cast("int")


def bad_delinquency(status: Column) -> Column:
    """Whether the token is neither a number nor a known mark."""
    t = F.coalesce(F.trim(status), F.lit(""))
    return ~F.upper(t).isin("X", "") & t.try_cast("int").isNull()


def months_back(day: Column, months: Column) -> Column:
    """First of the month that lies so many months before."""
    return F.trunc(F.add_months(day, -months), "MM")


def flag(c: Column) -> Column:
    return F.when(c == "Y", 1.0).otherwise(0.0)


def logistic(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def seeded(seed: int, *parts: Column) -> Column:
    """A number of 60 bits from the MD5 of seed and parts (nulls left out), which any SQL engine can give too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary")), 1, 15), 16, 10).cast("long")
