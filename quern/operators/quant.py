"""Quantization, packing and averaging of numeric row tables.

A matrix is a table of rows with an array of doubles.  Codes and scales are array
expressions, so a row never leaves its task; half-to-even rounding is ``rint``.
Scales stay in double precision; where the half-precision form matters, use
:func:`half`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

CLIP_Q = 0.9999984


@F.pandas_udf(DoubleType())
def half(x: pd.Series) -> pd.Series:
    """The value after a round trip through half precision."""
    return x.astype(np.float16).astype(np.float64)


def absolute(x: Column) -> Column:
    return F.transform(x, F.abs)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value taken once: filters that Spark moves below a projection put the expression itself in the place of its name, also in lambdas that run for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def quantile(x: Column, q: float) -> Column:
    """Exact quantile of an array with linear interpolation."""
    return bound(F.sort_array(F.array_compact(x)), lambda s: _sorted_quantile(s, q))


def _sorted_quantile(x: Column, q: float) -> Column:
    at = (F.size(x) - 1) * F.lit(q)
    lo = F.floor(at).cast("int")
    hi = F.ceil(at).cast("int")
    a, b = F.get(x, lo), F.get(x, hi)
    return a + (b - a) * (at - lo)


def codes(x: Column, scale: Column, low: int, high: int) -> Column:
    return bound(scale, lambda s: F.transform(x, lambda v: F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.rint(v / s)))))


def int8_rows(rows: DataFrame, x: str = "x", q: float = CLIP_Q, levels: int = 127) -> DataFrame:
    """``scale`` and ``q`` of each row: clip at a quantile, scale floored at 1/levels."""
    clip = quantile(absolute(F.col(x)), q)
    out = rows.withColumn("clip", clip).withColumn("scale", F.greatest(F.col("clip") / levels, F.lit(1.0 / levels)))
    clipped = bound(F.col("clip"), lambda c: F.transform(x, lambda v: F.greatest(-c, F.least(c, v))))
    return out.withColumn("q", codes(clipped, F.col("scale"), -levels, levels))


def amax_rows(rows: DataFrame, levels: int, x: str = "x", floor: float = 1e-12) -> DataFrame:
    """Row-wise codes in -(levels+1)..levels, scaled by the largest magnitude."""
    out = rows.withColumn("scale", F.greatest(F.array_max(absolute(F.col(x))) / levels, F.lit(floor)))
    return out.withColumn("q", codes(F.col(x), F.col("scale"), -(levels + 1), levels))


def dequantize(rows: DataFrame) -> DataFrame:
    return rows.withColumn("back", F.transform("q", lambda v: v * F.col("scale")))


def mean_square(x: Column, back: Column) -> Column:
    d = F.zip_with(x, back, lambda a, b: (a - b) * (a - b))
    return F.aggregate(d, F.lit(0.0), lambda a, v: a + v) / F.size(x)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def groups(x: Column, size: int) -> Column:
    """The array cut into groups, the last one padded with zeros."""
    n = F.size(x)
    padded = F.concat(x, F.array_repeat(F.lit(0.0), F.pmod(-n, F.lit(size))))
    return F.transform(F.sequence(F.lit(0), (F.size(padded) / size).cast("int") - 1), lambda g: F.slice(padded, g * size + 1, size))


def ternary_codes(group: Column) -> Column:
    """-1, 0 and 1 by the group's mean magnitude (at least 1e-8)."""
    scale = F.greatest(total(absolute(group)) / F.size(group), F.lit(1e-8))
    return F.transform(group, lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.rint(v / scale))))


def packed(digits: Column, base: int, per: int, fill: int = 0) -> Column:
    """Numbers of ``per`` digits each, first digit lowest; the last number is filled up."""
    d = F.concat(digits, F.array_repeat(F.lit(fill).cast("long"), F.pmod(-F.size(digits), F.lit(per))))
    return F.transform(F.sequence(F.lit(0), (F.size(d) / per).cast("int") - 1), lambda g: F.aggregate(F.reverse(F.slice(d, g * per + 1, per)), F.lit(0).cast("long"), lambda a, v: a * base + v))


def unpacked(numbers: Column, base: int, per: int, n: Column) -> Column:
    digits = F.flatten(F.transform(numbers, lambda v: F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda i: F.pmod(F.floor(v / F.pow(F.lit(float(base)), i)).cast("long"), F.lit(base)))))
    return F.slice(digits, 1, n)


def exact_quantile(cells: DataFrame, by: str, value: Column, q: float, most: int = 200_000) -> DataFrame:
    """``by, quantile``: the exact quantile of each group, interpolated linearly.

    Histograms of 1,024 bins narrow the values down to the bins that hold the
    wanted ranks, until a group has at most ``most`` values left, or only equal
    ones; only these are sorted.  So no task holds a group.
    """
    v = cells.select(by, value.alias("v")).where("v IS NOT NULL")
    near = v.groupBy(by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"), F.count("*").alias("inside"), F.lit(0).cast("long").alias("below"))
    k1, k2 = F.floor(F.lit(q) * (F.col("n") - 1)) - F.col("below"), F.ceil(F.lit(q) * (F.col("n") - 1)) - F.col("below")
    while near.where((F.col("inside") > most) & (F.col("lo") < F.col("hi"))).limit(1).count():
        held = v.join(F.broadcast(near), by).where("v BETWEEN lo AND hi")  # near has a row for each group
        share = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0)
        bins = held.groupBy(by, "n", "below", F.least(F.floor(share * 1024), F.lit(1023)).alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        upto = bins.withColumn("upto", F.sum("c").over(Window.partitionBy(by).orderBy("bin")))
        kept = upto.where((F.col("upto") > k1) & (F.col("upto") - F.col("c") <= k2))
        near = kept.groupBy(by, "n").agg(F.min("a").alias("lo"), F.max("b").alias("hi"), F.sum("c").alias("inside"), (F.max("below") + F.min(F.col("upto") - F.col("c"))).alias("below"))
        near = near.sparkSession.createDataFrame(near.collect(), near.schema)
    held = v.join(F.broadcast(near), by).where("v BETWEEN lo AND hi").groupBy(by, "n", "below", "v").agg(F.count("*").alias("c"))
    upto = held.withColumn("upto", F.sum("c").over(Window.partitionBy(by).orderBy("v")))
    ends = upto.groupBy(by, "n").agg(F.min(F.when(F.col("upto") > k1, F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > k2, F.col("v"))).alias("b"))
    at = F.lit(q) * (F.col("n") - 1)
    return ends.select(by, (F.col("a") + (F.col("b") - F.col("a")) * (at - F.floor(at))).alias("quantile"))


def gram(rows: DataFrame, x: str = "x", by: str | None = None) -> DataFrame:
    """``i, j, value`` of X'X (of each group ``by``): each batch adds up its own rows' products, then these are added."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, part in b.groupby(by, dropna=False) if by else [(None, b)] if len(b) else []:
                m = np.stack(part[x].to_numpy())
                m = m.T @ m
                i, j = np.indices(m.shape)
                yield pd.DataFrame(({by: key} if by else {}) | {"i": i.ravel(), "j": j.ravel(), "value": m.ravel()})

    keys = [by] if by else []
    head = f"{by} {rows.schema[by].dataType.simpleString()}, " if by else ""
    return rows.select(*keys, x).mapInPandas(partial, f"{head}i long, j long, value double").groupBy(*keys, "i", "j").agg(F.sum("value").alias("value"))


class Plane:
    """The lattice that a Gram matrix spans, for rounding rows of weights to a near point of it.

    The error of codes q with scale s is ``(w - s q)' G (w - s q)`` = ``|R (w - s q)|**2``
    with R'R = G.  R is triangular, so the last coordinate's best code depends on no
    other, the one before it on the last, and so on: each coordinate is rounded to
    the nearest plane, given what the later ones leave.  The heaviest coordinates
    come last and are rounded first.  Rows do not depend on each other.
    """

    def __init__(self, gram: np.ndarray, damping: float = 0.01):
        weight = np.diag(gram).copy()
        weight[weight == 0] = 1.0  # an input that never occurs: any code is right
        self.order = np.lexsort((-np.arange(len(weight)), weight))
        full = gram + np.diag(weight - np.diag(gram) + damping * weight.mean())
        upper = np.linalg.cholesky(full[np.ix_(self.order, self.order)]).T
        self.pull = upper / np.diag(upper)[:, None]

    def codes(self, rows: np.ndarray, scale: np.ndarray, levels: int) -> np.ndarray:
        w = rows[:, self.order]
        aim, q = w.copy(), np.empty_like(w)
        for k in range(w.shape[1] - 1, -1, -1):
            q[:, k] = np.clip(np.rint(aim[:, k] / scale), -levels, levels)
            aim[:, :k] += np.outer(w[:, k] - scale * q[:, k], self.pull[:k, k])
        out = np.empty_like(q)
        out[:, self.order] = q
        return out
