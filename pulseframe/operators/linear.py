"""Covariances, Mahalanobis distances and least squares: sums of products by aggregation, small matrices on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quantiles


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, covariance with n - 1) of rows without nulls; as many numbers as pairs of columns reach the driver."""
    full = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).na.drop()
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    got = full.agg(F.count("*").alias("n"), *[F.avg(f"c{i}").alias(f"m{i}") for i in range(len(columns))], *[F.covar_samp(f"c{i}", f"c{j}").alias(f"v{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = got[f"v{i}_{j}"] or 0.0
    return got["n"], np.array([got[f"m{i}"] or 0.0 for i in range(len(columns))]), cov


def shrunk_inverse(cov: np.ndarray, shrink: float, ridge: float = 1e-6) -> np.ndarray:
    """The inverse of a covariance moved towards its diagonal, with a little added to that."""
    return np.linalg.inv((1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + ridge * np.eye(len(cov)))


def mahalanobis(columns: list[str], means: np.ndarray, inverse: np.ndarray) -> Column:
    """The squared distance; an expression with as many products as the matrix has entries on and above its diagonal."""
    d = [F.col(c) - float(m) for c, m in zip(columns, means, strict=True)]
    out = F.lit(0.0)
    for i in range(len(d)):
        out = out + float(inverse[i, i]) * d[i] * d[i]
        for j in range(i + 1, len(d)):
            out = out + float(2 * inverse[i, j]) * d[i] * d[j]
    return out


def far_out(df: DataFrame, columns: list[str], share: float = 0.99) -> DataFrame:
    """df with distance and outside, beyond the given share of all distances; nulls count as means. The full covariance, inverted."""
    _, means, cov = moments(df, columns)
    filled = df.withColumns({c: F.coalesce(F.col(c), F.lit(float(m))) for c, m in zip(columns, means, strict=True)})
    inverse = np.linalg.pinv(cov + 1e-6 * np.eye(len(cov)))
    at = filled.withColumn("distance", F.sqrt(mahalanobis(columns, means, inverse)))
    return at.withColumn("outside", F.col("distance") > F.lit(quantiles.one(at, "distance", share)))


def least_squares_r2(df: DataFrame, basis: list[Column], target: Column) -> float | None:
    """R2 of the best linear combination of the basis (a constant is added), by normal equations of centred sums."""
    xs = [f"b{i}" for i in range(len(basis))]
    t = df.select(*[b.cast("double").alias(n) for b, n in zip(basis, xs, strict=True)], target.cast("double").alias("t"))
    n, means, cov = moments(t, [*xs, "t"])
    if n < 2 or cov[-1, -1] <= 0:
        return None
    sd = np.sqrt(np.maximum(np.diag(cov)[:-1], 0.0))
    live = sd > 0
    a = cov[:-1, :-1][np.ix_(live, live)] / np.outer(sd[live], sd[live])
    b = cov[:-1, -1][live] / sd[live]
    return float(b @ np.linalg.lstsq(a, b, rcond=1e-12)[0] / cov[-1, -1])


def usable(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns of which more than half the values are finite, and which vary."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    got = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("n", lambda c: F.avg(ok(c).cast("double"))), ("s", lambda c: F.stddev_pop(F.when(ok(c), F.col(c)))))]).first()
    return [c for i, c in enumerate(columns) if (got[f"n{i}"] or 0) > 0.5 and (got[f"s{i}"] or 0) > 0]
