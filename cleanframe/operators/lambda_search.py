"""Maximum-likelihood power of the Box-Cox and Yeo-Johnson transforms.

The log-likelihood is smooth in the power. Each round evaluates it at a few Chebyshev points of an interval, all
columns and points in one fused aggregate, and interpolates; the interval then shrinks around the maximum. Three
rounds reach the accuracy of a dense grid, and only scalars leave the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import as_double, nan_to_null
from ..plans.fused import agg_values

ROUNDS = ((2.5, 17), (0.3, 9), (0.03, 7))  # half-width and points per round
ZERO = 1e-10
MOVES = 20  # moves of the interval before a power is given up
VARIANCE_CHUNK = 9  # more variances in one pass outgrow what the JVM compiles


def boxcox(x: Column, power: float) -> Column:
    if abs(power) < ZERO:
        return F.ln(x)
    return (F.pow(x, F.lit(power)) - 1.0) / power


def yeojohnson(x: Column, power: float) -> Column:
    up = F.log1p(x) if abs(power) < ZERO else (F.pow(x + 1.0, F.lit(power)) - 1.0) / power
    rest = 2.0 - power
    down = -F.log1p(-x) if abs(rest) < ZERO else -(F.pow(1.0 - x, F.lit(rest)) - 1.0) / rest
    return F.when(x >= 0, up).otherwise(F.when(x < 0, down))


def boxcox_lambdas(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Best Box-Cox power per column, None where no power is best; every value must be above 0."""
    if not columns:
        return {}
    clean = nan_to_null(df)
    logs = agg_values(clean, {c: F.avg(F.ln(as_double(c))) for c in columns})
    # Dividing by the geometric mean leaves the best power unchanged and keeps large powers in range.
    centred = clean.select(*[(F.ln(as_double(c)) - F.lit(logs[c])).alias(f"c{i}") for i, c in enumerate(columns)])
    return _maximise(centred, columns, _boxcox_of_log, dict.fromkeys(columns, 0.0))


def yeojohnson_lambdas(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Best Yeo-Johnson power per column, None where no power is best; any values."""
    if not columns:
        return {}
    signed = [F.signum(as_double(c)) * F.log1p(F.abs(as_double(c))) for c in columns]
    logs = nan_to_null(df).select(*[s.alias(f"c{i}") for i, s in enumerate(signed)])
    jacobian = agg_values(logs, {c: F.avg(f"c{i}") for i, c in enumerate(columns)})
    return _maximise(logs, columns, _yeojohnson_of_log, jacobian)


# The searches read logarithms, so a candidate power costs one exponential a row.


def _boxcox_of_log(log: Column, power: float) -> Column:
    return log if abs(power) < ZERO else (F.exp(log * power) - 1.0) / power


def _yeojohnson_of_log(log: Column, power: float) -> Column:
    """``log`` is sign(x) * log1p(|x|)."""
    rest = 2.0 - power
    up = log if abs(power) < ZERO else (F.exp(log * power) - 1.0) / power
    down = log if abs(rest) < ZERO else (1.0 - F.exp(log * -rest)) / rest
    return F.when(log >= 0, up).otherwise(down)


def _maximise(
    logs: DataFrame, columns: Sequence[str], transform: Callable[[Column, float], Column], jacobian: dict[str, float]
) -> dict[str, float | None]:
    """Maximise (power - 1) * jacobian - ln(var) / 2 per column, the mean log-likelihood up to a constant.

    None for a column whose likelihood is not finite (an infinity), or still grows after MOVES moves of the interval.
    """
    values = {c: F.col(f"c{i}") for i, c in enumerate(columns)}
    best: dict[str, float | None] = {c: 0.0 if jacobian[c] is not None and math.isfinite(jacobian[c]) else None for c in columns}
    for half, points in ROUNDS:
        pending = {c: mid for c, mid in best.items() if mid is not None}
        for _ in range(MOVES):  # move the interval while the maximum sits on its edge
            if not pending:
                break
            nodes = {c: mid + half * np.cos(np.pi * (np.arange(points) + 0.5) / points) for c, mid in pending.items()}
            found = agg_values(
                logs, {(c, i): F.var_pop(transform(values[c], float(p))) for c in pending for i, p in enumerate(nodes[c])},
                chunk=VARIANCE_CHUNK,
            )
            moved = {}
            for c, mid in pending.items():
                spread = [found[(c, i)] for i in range(points)]
                usable = [i for i, v in enumerate(spread) if v is not None and 0.0 < v < math.inf]
                if len(usable) < 3:
                    best[c] = None
                    continue
                t = (nodes[c][usable] - mid) / half
                y = np.array([(nodes[c][i] - 1.0) * jacobian[c] - math.log(spread[i]) / 2.0 for i in usable])
                curve = np.polynomial.Chebyshev.fit(t, y, len(usable) - 1, domain=[-1, 1])
                grid = np.linspace(-1.0, 1.0, 20001)
                top = float(grid[int(np.argmax(curve(grid)))])
                best[c] = mid + half * top
                if abs(top) == 1.0:
                    moved[c] = best[c]
            pending = moved
        best.update(dict.fromkeys(pending))
    return best
