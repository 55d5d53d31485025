"""Sums of products over column pairs, complete or pairwise complete, in one pass after a pass for the means."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import as_double
from .fused import agg_values

NARROW = 10  # columns up to which compiled sums beat handing batches to NumPy

SUMS = ("n", "x", "y", "xx", "yy", "xy")
_CELLS = "i int, j int, n double, x double, y double, xx double, yy double, xy double"


def pair_sums(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Column means and, per pair (i, j) over the rows where both are present, the count and centred sums.

    ``x`` and ``xx`` belong to column i, ``y`` and ``yy`` to column j. Centring at the means first keeps the sums from
    cancelling. The driver sees k x k numbers.
    """
    k = len(columns)
    first = agg_values(df, {"n": F.count("*"), **{(c, f): g(as_double(c)) for c in columns for f, g in (("mean", F.avg), ("n", F.count))}})
    rows = first["n"]
    means = np.array([first[(c, "mean")] if first[(c, "mean")] is not None else 0.0 for c in columns], dtype=float)
    full = [first[(c, "n")] == rows for c in columns]
    centred = [as_double(c) - F.lit(float(m)) for c, m in zip(columns, means)]
    if k <= NARROW and all(full):
        exprs = {("x", i): F.sum(centred[i]) for i in range(k)}
        exprs.update({("xy", i, j): F.sum(centred[i] * centred[j]) for i in range(k) for j in range(i, k)})
        v = agg_values(df, exprs)
        x = np.array([v[("x", i)] or 0.0 for i in range(k)])
        xy = np.array([[v[("xy", min(i, j), max(i, j))] or 0.0 for j in range(k)] for i in range(k)])
        xx = np.repeat(np.diag(xy)[:, None], k, axis=1)
        xs = np.repeat(x[:, None], k, axis=1)
        return means, {"n": np.full((k, k), float(rows)), "x": xs, "y": xs.T, "xx": xx, "yy": xx.T, "xy": xy}
    # A task emits k x k numbers whatever its rows; they combine by (i, j) before the shuffle.
    batches = df.select(*[c.alias(f"c{i}") for i, c in enumerate(centred)])
    sums = [F.sum(s).alias(s) for s in SUMS]
    out = {s: np.zeros((k, k)) for s in SUMS}
    mirror = {"n": "n", "x": "y", "y": "x", "xx": "yy", "yy": "xx", "xy": "xy"}
    for r in batches.mapInPandas(_partial_sums, _CELLS).groupBy("i", "j").agg(*sums).collect():  # k x k / 2 rows
        for s in SUMS:
            out[s][r["i"], r["j"]] = r[s]
            out[mirror[s]][r["j"], r["i"]] = r[s]
    return means, out


def _partial_sums(batches):
    """One upper triangle of sums per task, whatever the number of rows in it."""
    total = None
    for pdf in batches:
        values = pdf.to_numpy(dtype=float, na_value=np.nan)
        there = (~np.isnan(values)).astype(float)
        z = np.where(there > 0, values, 0.0)
        block = [there.T @ there, z.T @ there, there.T @ z, (z * z).T @ there, there.T @ (z * z), z.T @ z]
        total = block if total is None else [a + b for a, b in zip(total, block)]
    if total is not None:
        i, j = np.triu_indices(len(total[0]))
        yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), **{s: t[i, j] for s, t in zip(SUMS, total)}})


def correlations(sums: dict[str, np.ndarray]) -> np.ndarray:
    """Pearson correlation per pair; NaN where a side is constant or fewer than two rows are complete."""
    n = np.maximum(sums["n"], 1.0)
    cov = sums["xy"] - sums["x"] * sums["y"] / n
    var_x, var_y = sums["xx"] - sums["x"] ** 2 / n, sums["yy"] - sums["y"] ** 2 / n
    with np.errstate(invalid="ignore", divide="ignore"):
        r = cov / np.sqrt(var_x * var_y)
    usable = (sums["n"] >= 2) & (var_x > 1e-14 * np.abs(sums["xx"])) & (var_y > 1e-14 * np.abs(sums["yy"]))
    return np.where(usable, np.clip(r, -1.0, 1.0), np.nan)
