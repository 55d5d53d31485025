"""Outliers over several columns by Mahalanobis distance."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chi2 import chi2_quantile
from ..functions.types import as_double, col, nan_to_null, numeric_columns
from ..functions.vocab import CONFIDENCE
from ..plans.fused import agg_values
from ..plans.gram import pair_sums

FLAG = "__multivariate_outlier__"
CONDITION_LIMIT = 1e12
WIDE = 24  # columns from which a product of matrices per batch replaces an expression of k x k terms


class SingularCovariance(ValueError):
    """The columns are linearly dependent (or nearly so): there is no usable inverse covariance."""


def _complete(columns: Sequence[str]) -> Column:
    return F.forall(F.array(*[col(c).isNotNull() for c in columns]), lambda there: there)


def _whitened(means: np.ndarray, inverse: np.ndarray):
    """Length of each row after whitening: with ``inverse = C C'`` the distance is the length of ``C' (x - mean)``."""
    turn = np.linalg.cholesky(inverse)

    @F.arrow_udf("double")
    def distance(rows: pa.Array) -> pa.Array:
        there = rows.is_valid().to_numpy(zero_copy_only=False)
        centred = rows.drop_null().flatten().to_numpy().reshape(-1, len(means)) - means
        out = np.zeros(len(rows))
        out[there] = np.linalg.norm(centred @ turn, axis=1)
        return pa.array(out, mask=~there)

    return distance


@dataclass(frozen=True)
class MahalanobisFit:
    """Means, inverse covariance (k x k, on the driver) and cutoff; ``distance`` is row-local: an expression of few columns, or
    a batched product of matrices for many.
    """

    columns: tuple[str, ...]
    means: tuple[float, ...]
    inverse: tuple[tuple[float, ...], ...]
    cutoff: float
    rows_used: int
    rows_total: int

    row_local = True

    @property
    def complete(self) -> Column:
        return _complete(self.columns)

    @property
    def distance(self) -> Column:
        values = [F.when(~F.isnan(as_double(c)), as_double(c)) for c in self.columns]
        if len(values) >= WIDE:
            row = F.array(*values)
            return _whitened(np.array(self.means), np.array(self.inverse))(F.when(F.forall(row, lambda x: x.isNotNull()), row))
        d = [x - F.lit(m) for x, m in zip(values, self.means)]
        terms = []
        for i in range(len(d)):
            row = reduce(lambda a, b: a + b, [F.lit(self.inverse[i][j] * (1.0 if i == j else 2.0)) * d[j] for j in range(i, len(d))])
            terms.append(d[i] * row)
        # Rounding can leave a tiny negative sum at the centre.
        square = reduce(lambda a, b: a + b, terms)
        return F.when(square.isNotNull(), F.sqrt(F.greatest(square, F.lit(0.0))))

    def apply(self, df: DataFrame, action: str = "flag") -> DataFrame:
        """``flag`` adds a boolean column (false for incomplete rows); ``drop`` removes the outliers."""
        clean = nan_to_null(df)
        outlier = F.coalesce(self.distance > self.cutoff, F.lit(False))
        if action == "flag":
            return clean.withColumn(FLAG, outlier)
        if action == "drop":
            return clean.filter(~outlier)
        raise ValueError("action must be 'flag' or 'drop'")


def fit_mahalanobis(df: DataFrame, columns: Sequence[str] | None = None, confidence: float = CONFIDENCE) -> MahalanobisFit:
    """Fit over rows complete in ``columns`` (default: all numeric): a pass for the means, one for the products."""
    names = numeric_columns(df, columns)
    if columns is not None and len(names) < len(list(columns)):
        raise ValueError(f"not numeric: {[c for c in columns if c not in names]}")
    k = len(names)
    if k < 2:
        raise ValueError("needs at least two numeric columns")
    clean = nan_to_null(df)
    complete = _complete(names)
    counts = agg_values(clean, {"total": F.count("*"), "used": F.count_if(complete)})
    if counts["used"] < k + 1:
        raise ValueError(f"needs at least {k + 1} complete rows, found {counts['used']}")
    means, sums = pair_sums(clean.filter(complete), names)
    n = counts["used"]
    means = means + np.diag(sums["x"]) / n
    cov = (sums["xy"] - sums["x"] * sums["y"] / n) / (n - 1)
    if not np.all(np.isfinite(cov)):
        raise ValueError(f"not all values are finite: {[c for c, v in zip(names, np.diag(cov)) if not math.isfinite(v)]}")
    scale = np.sqrt(np.diag(cov))
    # Conditioning is judged on the correlation matrix, so that units do not matter.
    if not np.all(scale > 0) or np.linalg.cond(cov / np.outer(scale, scale)) > CONDITION_LIMIT:
        raise SingularCovariance("columns are constant or linearly dependent; drop one of them")
    inverse = np.linalg.inv(cov / np.outer(scale, scale)) / np.outer(scale, scale)
    return MahalanobisFit(
        tuple(names), tuple(means.tolist()), tuple(map(tuple, inverse.tolist())),
        math.sqrt(chi2_quantile(confidence, k)), n, counts["total"],
    )


def mahalanobis_report(df: DataFrame, fit: MahalanobisFit) -> DataFrame:
    """One row: rows analysed, rows left out as incomplete, cutoff, outliers."""
    return nan_to_null(df).agg(
        F.count_if(fit.complete).alias("rows_analysed"),
        F.count_if(~fit.complete).alias("rows_incomplete"),
        F.lit(fit.cutoff).alias("threshold"),
        F.count_if(fit.distance > fit.cutoff).alias("outliers"),
    )


def mahalanobis_samples(df: DataFrame, fit: MahalanobisFit, order_by: Sequence[str], k: int = 5) -> DataFrame:
    """The ``k`` farthest rows with their distance; ``order_by`` breaks ties."""
    far = nan_to_null(df).withColumn("distance", fit.distance).filter(F.col("distance") > fit.cutoff)
    return far.orderBy(F.col("distance").desc(), *[col(c) for c in order_by]).limit(k)
