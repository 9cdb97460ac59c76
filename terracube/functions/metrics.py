"""Skill metrics as aggregate expressions of a truth and a prediction column.

Every metric is one Column, so that any number of them fits one ``groupBy(...).agg(...)`` with partial aggregation on the
map side. Pairs with a missing side are dropped (``nulls="drop"``) or make the metric NULL (``nulls="propagate"``).
A metric that is not defined (no pairs, no variance) is NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Metric = Callable[[Column, Column], Column]


def pair(true: Column, pred: Column) -> tuple[Column, Column]:
    """Both sides where both are present."""
    both = true.isNotNull() & pred.isNotNull()
    return F.when(both, true), F.when(both, pred)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def count_pairs(true: Column, pred: Column) -> Column:
    return F.count(true + pred)


def mse(true: Column, pred: Column) -> Column:
    return F.avg((pred - true) * (pred - true))


def rmse(true: Column, pred: Column) -> Column:
    return F.sqrt(mse(true, pred))


def weighted_mse(true: Column, pred: Column, weight: Column) -> Column:
    w = F.when((true + pred).isNotNull(), weight)
    return ratio(F.sum(w * (pred - true) * (pred - true)), F.sum(w))


def bias(true: Column, pred: Column) -> Column:
    return F.avg(pred - true)


def pbias(true: Column, pred: Column) -> Column:
    o, _ = pair(true, pred)
    return ratio(100 * F.avg(pred - true), F.avg(F.abs(o)))


def pearson(true: Column, pred: Column) -> Column:
    o, p = pair(true, pred)
    return ratio(F.covar_pop(o, p), F.stddev_pop(o) * F.stddev_pop(p))


def nse(true: Column, pred: Column, ref_mean: str = "pred") -> Column:
    """1 - sum (p-o)^2 / sum (o-m)^2, m the mean of the predictions (``ref_mean="pred"``) or of the truth ("obs").

    The denominator comes from central moments: var(o) + (mean(o) - m)^2, each n times.
    """
    o, p = pair(true, pred)
    away = F.avg(o) - F.avg(p if ref_mean == "pred" else o)
    return 1 - ratio(mse(true, pred), F.var_pop(o) + away * away)


def kge_parts(true: Column, pred: Column) -> dict[str, Column]:
    """r, alpha (ratio of sample deviations) and beta (ratio of means), prediction over truth."""
    o, p = pair(true, pred)
    return {"r": pearson(true, pred), "alpha": ratio(F.stddev_samp(p), F.stddev_samp(o)), "beta": ratio(F.avg(p), F.avg(o))}


def _distance(*parts: Column) -> Column:
    total = sum(((x - 1) * (x - 1) for x in parts[1:]), (parts[0] - 1) * (parts[0] - 1))
    return 1 - F.sqrt(total)


def kge(true: Column, pred: Column) -> Column:
    return _distance(*kge_parts(true, pred).values())


def kge_eps(true: Column, pred: Column, eps: float = 1e-8) -> Column:
    """KGE with denominators kept from 0 by ``eps``, as a loss uses it."""
    o, p = pair(true, pred)
    n = F.count(o)
    r = ratio(n * F.covar_pop(o, p), F.sqrt(n * F.var_pop(o) * n * F.var_pop(p) + eps))
    return _distance(r, ratio(F.stddev_samp(p), F.stddev_samp(o) + eps), ratio(F.avg(p), F.avg(o) + eps))


def gamma(true: Column, pred: Column) -> Column:
    """Ratio of the coefficients of variation, prediction over truth."""
    o, p = pair(true, pred)
    return ratio(ratio(F.stddev_pop(p), F.avg(p)), ratio(F.stddev_pop(o), F.avg(o)))


def variance(x: Column, std: bool = False) -> Column:
    return F.stddev_pop(x) if std else F.var_pop(x)


def nrmse(true: Column, pred: Column, norm_by: str = "pred") -> Column:
    """RMSE over the mean of one side."""
    o, p = pair(true, pred)
    return ratio(rmse(true, pred), F.avg(p if norm_by == "pred" else o))


def pinball(true: Column, pred: Column, tau: float) -> Column:
    if not 0 < tau < 1:
        raise ValueError("tau lies between 0 and 1")
    e = true - pred
    return F.avg(F.greatest(tau * e, (tau - 1) * e))


def gauss_nll(true: Column, mu: Column, sigma: Column) -> Column:
    """Mean negative log-likelihood of a normal distribution; rows with sigma of 0 or less are left out."""
    z = F.try_divide(true - mu, sigma)
    return F.avg(F.when(sigma > 0, F.ln(sigma) + 0.5 * F.ln(F.lit(2.0) * F.pi()) + 0.5 * z * z))


def bimodal_mse(true: Column, pred: Column, threshold: float = 0.5, high: float = 1.0, low: float = 0.5) -> Column:
    """MSE whose weights depend on the mode of the truth; weights are normalised by their mean."""
    return weighted_mse(true, pred, F.when(true > threshold, F.lit(high)).otherwise(F.lit(low)))


def range_penalty(x: Column, low: float, high: float, factor: float = 1.0) -> Column:
    """Mean distance outside [low, high], halved and times ``factor``."""
    zero = F.lit(0.0)
    return F.lit(factor) * F.avg(F.greatest(x - high, zero) + F.greatest(F.lit(low) - x, zero)) / F.lit(2.0)


METRICS: dict[str, Metric] = {"mse": mse, "rmse": rmse, "bias": bias, "pbias": pbias, "pearson": pearson, "nse": nse, "kge": kge, "gamma": gamma, "nrmse": nrmse}


def metric(name: str, true: Column, pred: Column, nulls: str = "drop", valid: Column | None = None) -> Column:
    """A metric by name, within an optional valid mask."""
    if valid is not None:
        true, pred = F.when(valid, true), F.when(valid, pred)
    out = METRICS[name](true, pred)
    if nulls == "propagate":
        gap = true.isNull() | pred.isNull()
        gap = gap & valid if valid is not None else gap
        return F.when(F.coalesce(F.bool_or(gap), F.lit(True)), F.lit(None)).otherwise(out)
    return out
