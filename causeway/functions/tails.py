"""Distribution functions without SciPy, for one-row results on the driver and for Arrow batches."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from causeway.functions.workers import by_value

by_value(__name__)


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return 1.0 if df <= 0 or math.isnan(t) else beta_cdf(df / (df + t * t), df / 2, 0.5)


def chi2_1_upper(x: float) -> float:
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def binomial_cdf(k: int, n: int, p: float) -> float:
    return 0.0 if k < 0 else 1.0 if k >= n else beta_cdf(1 - p, n - k, k + 1)


def mcnemar_p(b: int, c: int) -> tuple[float, float]:
    """The p-value as usually written, which may exceed 1 with few pairs, and the same capped at 1."""
    n = b + c
    if n == 0:
        return 1.0, 1.0
    raw = 2 * binomial_cdf(min(b, c), n, 0.5) if n < 25 else chi2_1_upper((abs(b - c) - 1) ** 2 / n)
    return raw, min(1.0, raw)


GAMMAS = (1.0, 1.1, 1.2, 1.3, 1.5, 1.75, 2.0, 3.0)


def rosenbaum(positive: int, negative: int, gammas: tuple[float, ...] = GAMMAS) -> list[tuple[float, float, float]]:
    """gamma and twice the sign test's lower tail at gamma / (1 + gamma) and at 1 / (1 + gamma); ties are left out before."""
    n, out = positive + negative, []
    for g in gammas:
        high, low = g / (1 + g), 1 / (1 + g)
        p = [2 * binomial_cdf(negative, n, q) if n else 1.0 for q in (high, low)]
        out.append((g, *(p if g == 1 else [min(1.0, x) for x in p])))
    return out


# the same as columns, for tables of a few results: Arrow batches, one call a row


def _column(f, *args: Column) -> Column:
    def run(*xs: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else float(f(*row)) for row in zip(*xs, strict=True)], dtype="float64")

    signature = {1: lambda a: run(a), 2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c)}[len(args)]
    hints = {1: ["a"], 2: ["a", "b"], 3: ["a", "b", "c"]}[len(args)]
    signature.__annotations__ = {**{h: pd.Series for h in hints}, "return": pd.Series}
    return F.pandas_udf(signature, "double")(*args)


def t_two_sided_column(t: Column, df: Column) -> Column:
    return _column(t_two_sided, t.cast("double"), df.cast("double"))


def mcnemar_p_column(b: Column, c: Column) -> Column:
    return _column(lambda x, y: mcnemar_p(int(x), int(y))[0], b, c)


def rosenbaum_column(up: Column, down: Column, gamma: Column, side: str) -> Column:
    return _column(lambda u, d, g: rosenbaum(int(u), int(d), (g,))[0][1 if side == "plus" else 2], up, down, gamma)
