"""Transforms of values as column expressions. Missing is NULL; an undefined result is NULL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def no_nan(x: Column | str) -> Column:
    """NaN becomes NULL, so that built-in aggregates skip it."""
    x = F.col(x) if isinstance(x, str) else x
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def log1p(x: Column) -> Column:
    return F.when(x > -1, F.log1p(x))


def exp_minus1(x: Column) -> Column:
    return F.expm1(x)


def log10p(x: Column) -> Column:
    """log10(x + 1)."""
    return F.when(x > -1, F.log10(x + 1))


def pow10_minus1(x: Column) -> Column:
    return F.pow(F.lit(10.0), x) - 1


TRANSFORMS = {"log1p": (log1p, exp_minus1), "log10p": (log10p, pow10_minus1)}


def preprocess(df: DataFrame, spec: Mapping[str, Sequence[str]], inverse: bool = False) -> DataFrame:
    """Apply each named transform to its own columns; columns without one stay as they are."""
    new = {c: TRANSFORMS[kind][int(inverse)](F.col(c)) for kind, columns in spec.items() for c in columns}
    return df.withColumns(new) if new else df


def scaled(x: Column, center: Column, scale: Column) -> Column:
    """(x - center) / scale; NULL where the scale is 0."""
    return F.try_divide(x - center, scale)


def unscaled(x: Column, center: Column, scale: Column) -> Column:
    return x * scale + center


def scaled11(x: Column, center: Column, scale: Column) -> Column:
    """Into [-1, 1] from a minimum and a range."""
    return 2 * F.try_divide(x - center, scale) - 1


def unscaled11(x: Column, center: Column, scale: Column) -> Column:
    return (x + 1) / F.lit(2.0) * scale + center


def sigmoid_range(x: Column, low: float, high: float) -> Column:
    """A free number as a parameter between two bounds."""
    return F.lit(low) + F.lit(high - low) / (1 + F.exp(-x))


def reclass(x: Column, breaks: Sequence[float]) -> Column:
    """Class i for breaks[i] <= x < breaks[i+1]; the last class has no upper end; below the first break x stays."""
    out = x.cast("double")
    for i, at in enumerate(breaks):
        out = F.when(x >= at, F.lit(float(i))).otherwise(out)
    return out


def with_uncertainty(value: Column, spread: Column) -> Column:
    """``value ± spread`` with five decimals."""
    return F.format_string("%.5f ± %.5f", value, spread)
