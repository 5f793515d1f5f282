"""Column expressions shared by the operators; all of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Severities from weakest to strongest.
SEVERITIES = ["INFO", "LOW", "MEDIUM", "WARNING", "HIGH", "CRITICAL"]

FLOATS = (T.FloatType, T.DoubleType)


def col(name: str) -> Column:
    """Column by exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN where the type can hold it."""
    c = col(name)
    if isinstance(df.schema[name].dataType, FLOATS):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def finite(c: Column) -> Column:
    """``c`` as a double; NULL when not a number, NaN or infinite."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def ratio(num: Column, den: Column, default: float | None = None) -> Column:
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


def severity_rank(c: Column) -> Column:
    """Position of a severity name in the fixed order; 0 when there is none."""
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), c), F.lit(0)).cast("int")


def severity_name(rank: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.greatest(rank, F.lit(1)))


def uniform(*keys: Column | int | str) -> Column:
    """Reproducible uniform in [0, 1): depends on the keys only, never on partitioning."""
    parts = [k if isinstance(k, Column) else F.lit(k) for k in keys]
    return F.pmod(F.xxhash64(*parts), F.lit(2**53)).cast("double") / F.lit(float(2**53))


def digest_uniform(seed: int, *parts: Column) -> Column:
    """Reproducible uniform in [0, 1) from the first 52 bits of an MD5 over seed and parts, which other engines can draw too."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def gaussian(*keys: Column | int | str) -> Column:
    """Reproducible standard normal value (Box-Muller over two hash uniforms)."""
    first = F.lit(1.0) - uniform(*keys, "radius")
    angle = uniform(*keys, "angle")
    return F.sqrt(F.lit(-2.0) * F.log(first)) * F.cos(F.lit(2.0) * F.pi() * angle)


WILSON_Z = 1.95996


def wilson(k: Column, n: Column, z: float = WILSON_Z) -> tuple[Column, Column]:
    """Lower and upper Wilson score bound of a proportion; 0 and 0 when n = 0."""
    k, n = k.cast("double"), n.cast("double")
    z2 = z * z
    p = F.try_divide(k, n)
    scale = F.try_divide(F.lit(1.0), F.lit(1.0) + F.try_divide(F.lit(z2), n))
    centre = (p + F.try_divide(F.lit(z2), n * 2)) * scale
    spread = F.lit(z) * F.sqrt(
        F.try_divide(p * (F.lit(1.0) - p), n) + F.try_divide(F.lit(z2), n * n * 4)
    ) * scale
    zero = F.lit(0.0)
    return (
        F.coalesce(F.greatest(centre - spread, zero), zero),
        F.when(n > 0, F.least(centre + spread, F.lit(1.0))).otherwise(zero),
    )


def row_key(df: DataFrame) -> Column:
    """Digest of a whole row: NULL and NaN are alike and differ from every text; each field carries its length."""
    parts = []
    for f in df.schema:
        text = col(f.name).cast("string")
        parts.append(F.when(missing(df, f.name), F.lit("-")).otherwise(F.concat(F.length(text), F.lit(":"), text)))
    return F.md5(F.concat(F.lit(""), *parts))


def digamma(n: Column) -> Column:
    """Digamma of a number from 1 on: six steps of the recurrence, then the asymptotic series."""
    x = n.cast("double")
    y = x + 6.0
    steps = [F.lit(1.0) / (x + float(i)) for i in range(6)]
    q = F.lit(1.0) / (y * y)
    series = q * (F.lit(-1 / 12) + q * (F.lit(1 / 120) + q * (F.lit(-1 / 252) + q * F.lit(1 / 240))))
    total = steps[0]
    for s in steps[1:]:
        total = total + s
    return F.log(y) - F.lit(0.5) / y + series - total
