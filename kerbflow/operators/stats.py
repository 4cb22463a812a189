"""Width statistics, outliers, sigma classes and area models.

Width samples have a key, a dense position ``i``, the length ``len`` from the sample before and a
width ``w``.  Areas are sums over segments, each between two neighbouring samples.
Percentiles are exact and linear between neighbours.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kerbflow.functions import geometry as G
from kerbflow.operators import curves

KEY = "path_id"


def _percentile(c, p: float) -> Column:
    return F.percentile(c, F.lit(p))


def mad_filter(samples: DataFrame, k: float, key: str = KEY) -> DataFrame:
    """Adds ``mad_kept``: within ``k`` median absolute deviations; all are kept if that is near 0."""
    med = samples.groupBy(key).agg(_percentile("w", 0.5).alias("med"))
    dev = samples.join(med, key).withColumn("dev", F.abs(F.col("w") - F.col("med")))
    mad = dev.groupBy(key).agg(_percentile("dev", 0.5).alias("mad"))
    return dev.join(mad, key).withColumn("mad_kept", (F.col("mad") <= 1e-6) | (F.col("dev") <= k * F.col("mad"))).drop("dev")


def width_stats(samples: DataFrame, key: str = KEY) -> DataFrame:
    return samples.groupBy(key).agg(
        F.count("w").alias("n"), _percentile("w", 0.5).alias("median"), F.avg("w").alias("mean"), _percentile("w", 0.1).alias("p10"), _percentile("w", 0.9).alias("p90"),
        F.stddev_pop("w").alias("sd"), F.min("w").alias("least"), F.max("w").alias("most"),
    )


def sigma_classed(samples: DataFrame, key: str = KEY) -> DataFrame:
    """Adds mean, sigma (at least 1e-6), the distance ``z`` in sigmas and its class; missing widths are red."""
    by = samples.groupBy(key).agg(F.avg("w").alias("mu"), F.greatest(F.stddev_pop("w"), F.lit(1e-6)).alias("sigma"))
    out = samples.join(by, key).withColumn("z", F.when(F.col("w").isNotNull(), F.abs(F.col("w") - F.col("mu")) / F.col("sigma")))
    return out.withColumn("class", G.sigma_class(F.coalesce("z", F.lit(1e9))))


def measured(samples: DataFrame) -> DataFrame:
    """Samples whose widths of 0 or less are none."""
    return samples.withColumn("w", F.when(F.col("w") > 0, F.col("w")))


def segments(samples: DataFrame, key: str = KEY) -> DataFrame:
    """(key, i, len, w): the segments between neighbours, with their mean width; null if either has none."""
    w = Window.partitionBy(key).orderBy("i")
    out = samples.select(key, "i", F.lead("len").over(w).alias("len"), ((F.col("w") + F.lead("w").over(w)) / 2).alias("w"), F.lead("i").over(w).alias("next"))
    return out.where("next is not null").drop("next")


def classed_segments(samples: DataFrame, key: str = KEY, positive: bool = True) -> DataFrame:
    """Segments with the mean, sigma (at least 1e-6), least and most of all widths, and their class; without a width red.

    A width of 0 or less is none, unless ``positive`` is off.
    """
    samples = measured(samples) if positive else samples
    by = samples.groupBy(key).agg(F.avg("w").alias("mu"), F.greatest(F.stddev_pop("w"), F.lit(1e-6)).alias("sigma"), F.min("w").alias("least"), F.max("w").alias("most"))
    out = segments(samples, key).join(by, key)
    return out.withColumn("class", G.sigma_class(F.coalesce(F.abs(F.col("w") - F.col("mu")) / F.col("sigma"), F.lit(1e9))))


def class_counts(samples: DataFrame, key: str = KEY, positive: bool = True) -> DataFrame:
    return classed_segments(samples, key, positive).groupBy("class").agg(F.count("*").alias("n"))


def _band(class_from: dict, side: Column) -> tuple[Column, Column]:
    """Low and high of a class's band, in sigmas from the mean by the side of the width, within the least and the most."""
    low, high = F.col("least"), F.col("most")
    for name, (a, b) in class_from.items():
        hit = F.col("class") == name
        up = (F.col("mu") + a * F.col("sigma"), F.col("mu") + b * F.col("sigma"))
        down = (F.col("mu") - b * F.col("sigma"), F.col("mu") - a * F.col("sigma"))
        low = F.when(hit, F.greatest(F.col("least"), F.when(side, up[0]).otherwise(down[0]))).otherwise(low)
        high = F.when(hit, F.least(F.col("most"), F.when(side, up[1]).otherwise(down[1]))).otherwise(high)
    return low, high


def area_model_1(samples: DataFrame, key: str = KEY, positive: bool = True) -> DataFrame:
    """Nominal, low and high area by the band of each segment's class, on the side of the mean where its width lies.

    Green reaches one sigma either way, yellow from one to two, red from two to the least or most
    width; the nominal width is kept in its band.  A segment without a width counts the mean,
    and anything from the least to the most.
    """
    seg = classed_segments(samples, key, positive)
    side = F.col("w") >= F.col("mu")
    low, high = _band({"green": (-1, 1), "yellow": (1, 2)}, side)
    red, known = F.col("class") == "red", F.col("w").isNotNull()
    low = F.when(red & known & side, F.greatest(F.col("least"), F.col("mu") + 2 * F.col("sigma"))).otherwise(low)
    high = F.when(red & known & ~side, F.least(F.col("most"), F.col("mu") - 2 * F.col("sigma"))).otherwise(high)
    seg = seg.withColumn("lo", low).withColumn("hi", high).withColumn("nom", F.when(known, F.least(F.greatest("w", "lo"), "hi")).otherwise(F.col("mu")))
    area = lambda c: F.coalesce(F.sum(F.col("len") * F.col(c)), F.lit(0.0))
    return seg.groupBy(key).agg(area("nom").alias("nominal"), area("lo").alias("low"), area("hi").alias("high"))


def area_model_2(samples: DataFrame, key: str = KEY, positive: bool = True) -> DataFrame:
    """The mean width along the whole length, its low and high by class (one sigma, two, all), and what each class takes off or adds."""
    seg = classed_segments(samples, key, positive)
    low, high = _band({"green": (-1, 1), "yellow": (-2, 2)}, F.lit(True))
    seg = seg.withColumn("lo", low).withColumn("hi", high)
    area = lambda v: F.coalesce(F.sum(F.col("len") * v), F.lit(0.0))
    part = lambda c, v: area(F.when(F.col("class") == c, F.greatest(F.lit(0.0), v)))
    by_class = [p for c in ("green", "yellow", "red") for p in (part(c, F.col("mu") - F.col("lo")).alias(f"{c}_down"), part(c, F.col("hi") - F.col("mu")).alias(f"{c}_up"))]
    return seg.groupBy(key).agg(area(F.col("mu")).alias("baseline"), area(F.col("lo")).alias("low"), area(F.col("hi")).alias("high"), *by_class)


def area_model_3(samples: DataFrame, span: int = 4, key: str = KEY, positive: bool = True) -> DataFrame:
    """The mean of the interpolated widths, with bands drawn in to the 5th and 95th percentile.

    Red segments take the 20th and 80th percentile of the ``span`` segments on either side.
    """
    samples = measured(samples) if positive else samples
    seg = segments(curves.interpolated(samples, "w", key).withColumn("w", F.col("w_filled")), key)
    by = seg.groupBy(key).agg(F.avg("w").alias("mu"), F.greatest(F.stddev_pop("w"), F.lit(1e-6)).alias("sigma"), _percentile("w", 0.05).alias("least"), _percentile("w", 0.95).alias("most"))
    seg = seg.join(by, key).withColumn("class", G.sigma_class(F.abs(F.col("w") - F.col("mu")) / F.col("sigma")))
    frame = Window.partitionBy(key).orderBy("i").rowsBetween(-span, span)
    seg = seg.withColumn("p20", _percentile("w", 0.2).over(frame)).withColumn("p80", _percentile("w", 0.8).over(frame))
    low, high = _band({"green": (-1, 1), "yellow": (-2, 2)}, F.lit(True))
    red = F.col("class") == "red"
    seg = seg.withColumn("a", F.when(red, F.greatest("least", "p20")).otherwise(low)).withColumn("b", F.when(red, F.least("most", "p80")).otherwise(high))
    area = lambda v: F.coalesce(F.sum(F.col("len") * v), F.lit(0.0))
    return seg.groupBy(key).agg(area(F.col("mu")).alias("nominal"), area(F.least("a", "b")).alias("low"), area(F.greatest("a", "b")).alias("high"))


def chosen_widths(samples: DataFrame, method: str, window: int = 5, scale: float = 1.0, key: str = KEY) -> DataFrame:
    """Adds ``width``: the median of all, the sample's own (else the median), or that smoothed over a window; times ``scale``."""
    if method not in ("median", "local", "smooth"):
        raise ValueError(f"unknown width method {method}")
    med = samples.groupBy(key).agg(_percentile("w", 0.5).alias("med"))
    out = samples.join(med, key)
    own = F.col("med") if method == "median" else F.coalesce("w", "med")
    if method == "smooth" and window > 1:
        own = F.avg(own).over(Window.partitionBy(key).orderBy("i").rowsBetween(-(window // 2), window // 2))
    return out.withColumn("width", own * scale).drop("med")


def trapezoid(samples: DataFrame, width: Column | None = None, key: str = KEY) -> DataFrame:
    """Area between neighbouring samples with a width, and the length over all neighbours.

    ``len`` is the distance to the sample before.
    """
    w = Window.partitionBy(key).orderBy("i")
    out = samples.withColumn("v", F.col("w") if width is None else width).withColumn("before", F.lag("v").over(w)).withColumn("has", F.lag("i").over(w).isNotNull())
    return out.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("has"), F.col("len") * (F.col("v") + F.col("before")) / 2)), F.lit(0.0)).alias("area"), F.coalesce(F.sum(F.when(F.col("has"), F.col("len"))), F.lit(0.0)).alias("length"))


def sigma_envelope(classed: DataFrame, key: str = KEY) -> DataFrame:
    """Trapezoid areas of the widths less and plus 0, 1 or 2 sigmas by class; no width below 0."""
    delta = F.col("sigma") * F.when(F.col("class") == "green", 0).when(F.col("class") == "yellow", 1).otherwise(2)
    low = trapezoid(classed, F.greatest(F.col("w") - delta, F.lit(0.0) * F.col("w")), key).select(key, F.col("area").alias("low"))
    high = trapezoid(classed, F.col("w") + delta, key).select(key, F.col("area").alias("high"))
    return low.join(high, key)


def half_width(samples: DataFrame, percent: float, most: int, key: str = KEY) -> DataFrame:
    """A percentile (5 to 95) of the widths, rounded, from 2 to ``most``."""
    p = min(max(percent, 5.0), 95.0) / 100
    w = Window.partitionBy(key)
    at = F.lit(p) * (F.count("w").over(w) - 1)
    ranked = samples.select(key, "w", at.alias("at"), (F.row_number().over(w.orderBy(F.col("w").asc_nulls_last())) - 1).alias("rank"))
    value = lambda place: F.max(F.when(F.col("rank") == place(F.col("at")), F.col("w")))
    ends = ranked.groupBy(key).agg(value(F.floor).alias("low"), value(F.ceil).alias("high"), F.max(F.col("at") - F.floor("at")).alias("share"))
    middle = _weighed(F.col("low"), F.col("high"), F.col("share"))
    return ends.select(key, F.greatest(F.lit(2), F.least(F.lit(most), F.bround(middle).cast("int"))).alias("half_width"))


@F.pandas_udf(DoubleType())
def _weighed(low: pd.Series, high: pd.Series, share: pd.Series) -> pd.Series:
    """The share's place between two values, the lower one's part added before it is rounded: halves are then told as the SQL tells them."""
    put = lambda a, b, s: None if a is None or a != a else float(Fraction(1 - s) * Fraction(a) + Fraction(s * b))
    return pd.Series([put(*row) for row in zip(low, high, share)], dtype="float64")


def without_high_widths(samples: DataFrame, key: str = KEY) -> DataFrame:
    """Widths over the median and two sigmas are no measurements (keys of four or more)."""
    by = samples.groupBy(key).agg(_percentile("w", 0.5).alias("med"), F.stddev_pop("w").alias("sd"), F.count("w").alias("n"))
    out = samples.join(by, key)
    return out.withColumn("w", F.when((F.col("n") < 4) | (F.col("w") <= F.col("med") + 2 * F.col("sd")), F.col("w"))).drop("med", "sd", "n")
