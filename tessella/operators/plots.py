"""What plots of metrics are drawn from: histograms that can be added up, and densities worked out from them."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["img", "metric"]
Ranges = dict[str, tuple[float, float]]


def _of(metric: Column, ranges: Ranges, pick) -> Column:
    """A constant of each metric."""
    return functools.reduce(lambda acc, m: acc.when(metric == m, F.lit(float(pick(*ranges[m])))), ranges, F.when(F.lit(False), F.lit(0.0)))


def histograms(metrics: DataFrame, ranges: Ranges, bounds: Ranges, bins: int = 64) -> DataFrame:
    """(img, metric, bin, n, excluded): objects by the bin of each metric, and how many of them its bounds exclude; one shuffle of at most `bins` + 2 rows a metric, image and task.

    ranges: what the bins 0 to bins - 1 cover, the upper end in the last; bin -1 is below and bin `bins` above. Missing values are in no bin. An open bound is infinite.
    """
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v"), F.when(F.col(m).between(*map(F.lit, map(float, bounds.get(m, (-math.inf, math.inf))))), 0).otherwise(1).alias("out")) for m in ranges))
    each = metrics.select("img", F.explode(pairs).alias("p")).select("img", "p.*").where("v is not null and not isnan(v)")
    lo, hi = (_of(F.col("metric"), ranges, lambda a, b, k=k: (a, b)[k]) for k in (0, 1))
    place = F.floor((F.col("v") - lo) / (hi - lo) * bins)
    bin_ = F.when(F.col("v") < lo, -1).when(F.col("v") > hi, bins).otherwise(F.least(place, F.lit(bins - 1))).cast("int")
    return each.groupBy(*KEY, bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum("out").cast("long").alias("excluded"))


def added(*parts: DataFrame) -> DataFrame:
    """The histogram of several tables' objects from theirs (same ranges and bins), such as those of runs or days."""
    return functools.reduce(DataFrame.unionByName, parts).groupBy(*KEY, "bin").agg(F.sum("n").alias("n"), F.sum("excluded").alias("excluded"))


def densities(hist: DataFrame, ranges: Ranges, bins: int = 64) -> DataFrame:
    """(img, metric, value, density, kept): densities of all objects and of those within the bounds at the middle of each bin, by a normal kernel over the bins.

    The kernel's width is the deviation of the binned values times n^(-1/5), or a bin where all are in one; both densities are parts of all objects in the
    range and have one width, so that the second lies under the first. A metric and image are one row with `bins` numbers.
    """
    lo, hi = (_of(F.col("metric"), ranges, lambda a, b, k=k: (a, b)[k]) for k in (0, 1))
    step = (hi - lo) / bins
    middle = lo + (F.col("bin") + 0.5) * step
    inside = hist.where((F.col("bin") >= 0) & (F.col("bin") < bins)).withColumn("x", middle).withColumn("step", step)
    one = inside.groupBy(*KEY).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("x")).alias("s"), F.sum(F.col("n") * F.col("x") * F.col("x")).alias("ss"), F.first("step").alias("step"), F.collect_list(F.struct("x", F.col("n").cast("double").alias("n"), (F.col("n") - F.col("excluded")).cast("double").alias("k"))).alias("cells"))
    spread = F.sqrt(F.greatest((F.col("ss") - F.col("s") * F.col("s") / F.col("total")) / F.nullif(F.col("total") - 1, F.lit(0)), F.lit(0.0)))
    width = F.when(spread > F.col("step") * 1e-6, spread * F.pow(F.col("total"), F.lit(-0.2))).otherwise(F.col("step"))
    spots = one.withColumn("width", width).select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).withColumn("value", middle)

    def density(name: str) -> Column:
        near = F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + c[name] * F.exp(-0.5 * F.pow((F.col("value") - c["x"]) / F.col("width"), F.lit(2))))
        return near / (F.col("total") * F.col("width") * math.sqrt(2 * math.pi))

    return spots.select(*KEY, "value", density("n").alias("density"), density("k").alias("kept"))
