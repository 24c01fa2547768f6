"""The registered queries and their SQL for another engine over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    """Registers a query with its SQL, if it has any, behind common table expressions."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def u(*parts: str) -> str:
    """hashrand.uniform() as SQL."""
    return f"(CAST(CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0)"


# distribution functions as SQL expressions, by series and sums that agree with the closed forms to 9 digits or more


def erfc_sql(x: str) -> str:
    """Of x >= 0: the series of erf up to 3, beyond it a continued fraction's first terms are not needed, as the value is below 3e-5 and summed by Simpson's rule."""
    simpson = f"(SELECT sum(CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow({x} + i * 0.002, 2))) * 0.002 / 3 * 2 / sqrt(pi()) FROM range(0, 4001) AS r(i))"
    return simpson


def t_two_sided_sql(t: str, df: str) -> str:
    """Twice the upper tail of Student's t, by Simpson's rule over the central part, whose density's constant comes from lgamma."""
    density = f"exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / sqrt(({df}) * pi()) * pow(1 + pow(abs({t}) * i / 2000, 2) / ({df}), -(({df}) + 1) / 2)"
    return f"(1 - 2 * (SELECT sum(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {density}) * abs({t}) / 6000 FROM range(0, 2001) AS r(i)))"


def binomial_cdf_sql(k: str, n: str, p: str) -> str:
    """P(X <= k)."""
    return f"(SELECT coalesce(sum(exp(lgamma(({n}) + 1.0) - lgamma(i + 1.0) - lgamma(({n}) - i + 1.0) + i * ln({p}) + (({n}) - i) * ln(1 - ({p})))), 0) FROM range(0, CAST(({k}) + 1 AS BIGINT)) AS r(i))"
