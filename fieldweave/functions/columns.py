"""Column helpers: missing values, guarded arithmetic, rounding, grid keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """The value, or null where it is NaN or infinite: null is the only missing value here."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def clean_numbers(df: DataFrame) -> DataFrame:
    """All float and double columns with NaN and infinities as null."""
    floats = [n for n, k in df.dtypes if k in ("double", "float")]
    return df.withColumns({n: finite(n) for n in floats}) if floats else df


def number(c: str | Column, decimal_comma: bool = False) -> Column:
    """Text as a number; what is none becomes null."""
    c = F.trim(col(c).cast("string"))
    return finite((F.replace(c, F.lit(","), F.lit(".")) if decimal_comma else c).try_cast("double"))


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(col(a), col(b))


def rounded(c: str | Column, digits: int = 4) -> Column:
    """Half-up rounding without a negative zero, for results that are compared."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)


def cell(c: str | Column, size: float | Column, origin: float | Column = 0.0) -> Column:
    """Index of the grid cell that holds a coordinate."""
    size, origin = (x if isinstance(x, Column) else F.lit(float(x)) for x in (size, origin))
    return F.floor((col(c) - origin) / size).cast("long")


def turn(a: Column) -> Column:
    """An angle difference brought into [-180, 180)."""
    return F.pmod(a + 180.0, F.lit(360.0)) - 180.0


def pearson(x: str | Column, y: str | Column) -> Column:
    """Aggregate: correlation, null where either side is constant (corr would fail under ANSI)."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.when(F.count(x) >= 3, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def quantile(c: str | Column, p: float) -> Column:
    """Aggregate: the exact percentile, linearly interpolated."""
    return F.percentile(col(c), F.lit(p))
