"""Adjusted p-values as DataFrame plans.

Tests of equal p get equal adjusted values, so the work is done on the distinct p with
their numbers of tests.  These are cut into ranges of about ``PER_RANGE``; ranks and
running extremes are taken within a range and completed by those of the ranges before or
after it, of which there is a row each.  No window holds all tests.

Hommel's method alone looks at one family of tests as a whole; it refuses a family of
more than ``MAX_FAMILY``.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("bonferroni", "holm", "hochberg", "hommel", "bh", "by", "tsbh")
PER_RANGE = 200_000
MAX_FAMILY = 5_000_000
TWO_STAGE_LEVEL = 0.1
EULER_GAMMA = 0.5772156649015329


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m; above 1000 by the expansion, which is exact to double precision there."""
    n = F.greatest(m, F.lit(1)).cast("double")
    series = F.ln(n) + EULER_GAMMA + 1 / (2 * n) - 1 / (12 * n * n) + 1 / (120 * n * n * n * n)
    summed = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(1000.0)).cast("int")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / i)
    return F.when(n > 1000, series).otherwise(summed)


def _ranges(values: DataFrame, p: str, n: int) -> Column:
    """The number of the range that p lies in; bounds are quantiles, a driver's list of a few numbers."""
    count = -(-n // PER_RANGE)
    if count <= 1:
        return F.lit(0)
    bounds = sorted(set(values.approxQuantile(p, [i / count for i in range(1, count)], 0.25 / count)))
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(p)))


def ranks(tests: DataFrame, p: str, keys: list[str] = ()) -> DataFrame:
    """The distinct p of each family with their first and last rank, the range and the family's size ``m``."""
    values = tests.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("__c"))
    values = values.withColumn("__range", _ranges(values, p, values.count()))
    sizes = values.groupBy(*keys, "__range").agg(F.sum("__c").alias("__in"))
    before = Window.partitionBy(*keys).orderBy("__range")
    offsets = sizes.withColumn("__before", F.sum("__in").over(before) - F.col("__in")).withColumn("m", F.sum("__in").over(Window.partitionBy(*keys)))
    ranked = values.withColumn("__last", F.sum("__c").over(Window.partitionBy(*keys, "__range").orderBy(p)))
    on = [*keys, "__range"]
    joined = ranked.join(offsets.drop("__in"), on)  # a row a family and range
    last = F.col("__last") + F.col("__before")
    return joined.select(*keys, p, "__range", "m", (last - F.col("__c") + 1).alias("first"), last.alias("last"))


def _running(values: DataFrame, p: str, keys: list[str], value: Column, up: bool) -> DataFrame:
    """``values`` with p_adj: the greatest value up to each p, or the least value from it on."""
    extreme = F.max if up else F.min
    ordered = F.col(p).asc() if up else F.col(p).desc()
    far = F.col("__range").asc() if up else F.col("__range").desc()
    rows = values.withColumn("__v", value)
    whole = rows.groupBy(*keys, "__range").agg(extreme("__v").alias("__e"))
    beyond = whole.withColumn("__beyond", extreme("__e").over(Window.partitionBy(*keys).orderBy(far).rowsBetween(Window.unboundedPreceding, -1))).drop("__e")
    inside = rows.withColumn("__run", extreme("__v").over(Window.partitionBy(*keys, "__range").orderBy(ordered)))
    pick = F.greatest if up else F.least
    return inside.join(beyond, [*keys, "__range"]).withColumn("p_adj", pick("__run", "__beyond"))


def adjust(tests: DataFrame, p: str, method: str, keys: list[str] = ()) -> DataFrame:
    """``tests`` with p_adj by one of METHODS, within the families of ``keys``; a null p stays null and is no test.

    tsbh is the two-stage Benjamini-Hochberg procedure at the level TWO_STAGE_LEVEL."""
    keys = list(keys)
    if method not in METHODS:
        raise ValueError(f"{method!r} is none of {', '.join(METHODS)}")
    c = F.col
    if method == "hommel":
        families = tests.where(c(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("__c"))
        kinds = dict(tests.dtypes)

        def family(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(p)
            if rows["__c"].sum() > MAX_FAMILY:
                raise ValueError(f"Hommel's method is for at most {MAX_FAMILY} tests")
            each = hommel(np.repeat(rows[p].to_numpy(), rows["__c"].to_numpy()))
            return rows[[*keys, p]].assign(p_adj=each[np.cumsum(rows["__c"].to_numpy()) - 1])

        schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, p]) + ", p_adj double"
        found = families.groupBy(*(keys or [F.lit(0).alias("__all")])).applyInPandas(family, schema)
    else:
        values = ranks(tests, p, keys)
        if method == "bonferroni":
            found = values.withColumn("p_adj", c(p) * c("m"))
        elif method == "holm":
            found = _running(values, p, keys, c(p) * (c("m") - c("first") + 1), True)
        elif method == "hochberg":
            found = _running(values, p, keys, c(p) * (c("m") - c("last") + 1), False)
        else:
            found = _running(values, p, keys, c(p) * c("m") / c("last"), False)
            if method == "by":
                found = found.withColumn("p_adj", c("p_adj") * harmonic(c("m")))
            elif method == "tsbh":
                level = TWO_STAGE_LEVEL / (1 + TWO_STAGE_LEVEL)
                passed = F.max(F.when(c("p_adj") <= level, c("last")).otherwise(0)).over(Window.partitionBy(*keys)) if keys else None
                if passed is None:  # one number for the whole table
                    passed = F.lit(found.agg(F.max(F.when(c("p_adj") <= level, c("last")).otherwise(0))).first()[0] or 0)
                found = found.withColumn("__left", c("m") - passed)
                found = found.withColumn("p_adj", c("p_adj") * F.when(c("__left") > 0, c("__left")).otherwise(c("m")) / c("m") * (1 + TWO_STAGE_LEVEL))
    found = found.select(*keys, p, F.least("p_adj", F.lit(1.0)).alias("p_adj"))
    return tests.join(found, [*keys, p], "left").select(*tests.columns, "p_adj")


def simes(s: np.ndarray) -> np.ndarray:
    """Of sorted p-values: for k = 1, 2, ..., n the Simes p-value of the k largest.

    That is k times the least slope of a line from (n - k, 0) to a point (rank, p) right
    of it, which touches the lower hull of those points; the hull grows leftwards."""
    n = len(s)
    out = np.empty(n)
    hull: list[tuple[int, float]] = []  # right to left

    def turns(a: tuple, b: tuple, q: tuple) -> bool:
        """Whether b lies on or above the line from a to q."""
        return (b[1] - a[1]) * (q[0] - a[0]) <= (q[1] - a[1]) * (b[0] - a[0])

    for k in range(1, n + 1):
        x = n - k
        new = (x + 1, float(s[x]))
        while len(hull) > 1 and turns(hull[-2], hull[-1], new):
            hull.pop()
        hull.append(new)
        low, high = 0, len(hull) - 1  # slopes from (x, 0) fall, then rise along the hull
        while low < high:
            mid = (low + high) // 2
            a, b = hull[mid], hull[mid + 1]
            if a[1] / (a[0] - x) < b[1] / (b[0] - x):
                high = mid
            else:
                low = mid + 1
        near = hull[max(0, low - 1) : low + 2]
        out[k - 1] = k * min(p / (r - x) for r, p in near)
    return out


def hommel(s: np.ndarray) -> np.ndarray:
    """Adjusted values of sorted p-values by closed testing with Simes tests.

    At level a the hypotheses of the k largest p-values together are kept if their Simes
    p-value is above a; with h the largest such k, a hypothesis is rejected if h p <= a.
    So its adjusted value is the least, over h, of max(h p, the Simes p-values of all
    more than h)."""
    n = len(s)
    if not n:
        return np.zeros(0)
    beyond = np.append(np.maximum.accumulate(simes(s)[::-1])[::-1], 0.0)  # at h: the largest of more than h
    out = np.empty(n)
    for i, p in enumerate(s.tolist()):
        h = bisect_left(range(n + 1), True, key=lambda h: h * p >= beyond[h])
        out[i] = min(max(k * p, beyond[k]) for k in (h - 1, h) if 0 <= k <= n)
    return np.minimum(np.maximum(out, s), 1.0)
