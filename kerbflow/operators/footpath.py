"""Areas of footpaths from a page picture, a mask and a centreline in one call, with settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.functions import geometry as G
from kerbflow.operators import boundary, curves, raster
from kerbflow.operators.graph import checkpointed

PLACE = ["page", "y", "x"]


# The settings' defaults.
@dataclass(frozen=True)
class WidthSettings:
    """How widths are probed: distances in pixels, colours as 8-bit hue (0 to 179), saturation and value."""

    step: float = 2.0
    max_probe: float = 25.0
    probe_step: float = 1.0
    snap_radius: int = 6
    black_run: int = 1
    outside_run: int = 1
    outside_grace: float = 80.0
    close_kernel: int = 3
    black_value: int = 45
    support_value: int = 55
    gray_saturation: int = 20
    gray_value: int = 90
    green_hue: tuple[int, int] = (35, 95)
    green_saturation: int = 55
    green_value: int = 35
    support_pad: float = 2.0
    rescue_low_sigma: float = 0.5
    rescue_extra_sigma: float = 1.0
    rescue_support_ratio: float = 0.6


def _placed(df: DataFrame, *more) -> DataFrame:
    return df.select(F.col("page").cast("long").alias("page"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *more)


def support_and_black(mask: DataFrame, picture: DataFrame, size: tuple[int, int], s: WidthSettings = WidthSettings()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """The pixels on which a path may lie: the mask, its small gaps closed, and what is not black close to it; and the black pixels.

    ``picture`` is (page, y, x, r, g, b) with 8-bit channels.
    """
    m = _placed(mask).distinct()
    if s.close_kernel > 1:
        m = raster.closed(m, raster.ellipse_kernel(s.close_kernel | 1), size)
    m = checkpointed(m)
    h, sat, v = G.hsv(F.col("r"), F.col("g"), F.col("b"))
    p = checkpointed(_placed(picture, h.alias("h"), sat.alias("s"), v.alias("v")))
    r = int(s.support_pad)
    disc = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= s.support_pad**2]
    gray = (F.col("s") <= s.gray_saturation) & (F.col("v") >= s.gray_value)
    green = F.col("h").between(*s.green_hue) & (F.col("s") >= s.green_saturation) & (F.col("v") >= s.green_value)
    near = p.where((F.col("v") >= s.support_value) | gray | green).join(raster.dilated(m, disc, size), PLACE, "left_semi").select(*PLACE)
    return checkpointed(m.unionByName(near).distinct()), checkpointed(p.where(F.col("v") <= s.black_value).select(*PLACE).distinct())


def snapped_to_mask(points: DataFrame, mask: DataFrame, radius: int, key: str = "path_id") -> DataFrame:
    """Points (key, i, page, x, y) moved to the nearest set pixel of the square around them, if they are not on one; adds ``rx``, ``ry``, ``snapped``.

    Of equally near pixels the first by (y, x); points without one stay.
    """
    p = points.withColumn("py", F.bround("y").cast("int")).withColumn("px", F.bround("x").cast("int"))
    span = F.sequence(F.lit(-radius), F.lit(radius))
    tried = p.withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span))
    tried = tried.select(key, "i", "page", (F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")).alias("d"), (F.col("py") + F.col("dy")).alias("y"), (F.col("px") + F.col("dx")).alias("x"))
    best = tried.join(mask, PLACE, "left_semi").groupBy(key, "i").agg(F.min(F.struct("d", "y", "x")).alias("b"))
    out = p.join(best, [key, "i"], "left")
    moves = F.coalesce(F.col("b.d") > 0, F.lit(False))
    put = lambda c: F.when(moves, F.col(f"b.{c}").cast("double")).otherwise(F.col(c)).alias(c)
    return out.select(key, "i", "page", put("x"), put("y"), F.col("x").alias("rx"), F.col("y").alias("ry"), moves.alias("snapped"))


def path_widths(paths: DataFrame, mask: DataFrame, picture: DataFrame, size: tuple[int, int], settings: WidthSettings | None = None, key: str = "path_id") -> DataFrame:
    """(key, i, x, y, d_pos, d_neg, w, valid, reason, rescued, snapped): stations along paths (key, i, page, x, y) with their widths.

    Paths are cut into steps, put on the support, probed to either side, looked at again where they are short,
    and freed of widths over the median and two deviations, which a text next to the path makes.
    """
    s = settings or WidthSettings()
    pages = paths.groupBy(key).agg(F.first("page").cast("long").alias("page"))
    dense = curves.densified(paths.select(key, "i", "x", "y"), s.step, key)
    n = F.row_number().over(Window.partitionBy(key).orderBy("i", "k")) - 1
    dense = dense.select(key, n.cast("long").alias("i"), F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y")).join(pages, key)
    support, black = support_and_black(mask, picture, size, s)
    put = checkpointed(snapped_to_mask(dense, support, s.snap_radius, key))
    w = boundary.station_widths(put.drop("snapped"), support, black, size, s.max_probe, s.probe_step, s.black_run, s.outside_run, s.outside_grace, key)
    w = boundary.rescued_widths(w, support, black, size, s.max_probe, s.probe_step, s.rescue_low_sigma, s.rescue_extra_sigma, s.rescue_support_ratio, s.black_run, s.outside_run, key=key)
    by = w.groupBy(key).agg(F.expr("percentile(w, 0.5)").alias("med"), F.stddev_pop("w").alias("sd"), F.count("w").alias("n"))
    w = w.join(by, key).join(put.select(key, "i", "snapped"), [key, "i"])
    wide = F.coalesce((F.col("n") >= 4) & (F.col("w") > F.col("med") + 2 * F.col("sd")), F.lit(False))
    return w.select(key, "i", "x", "y", "d_pos", "d_neg", "w", (F.col("w").isNotNull() & ~wide).alias("valid"), F.when(wide, "text_outlier").otherwise(F.col("reason")).alias("reason"), "rescued", "snapped")


def path_areas(widths: DataFrame, m_per_px: float, key: str = "path_id") -> DataFrame:
    """(key, length_m, area_m2, area_min_m2, area_max_m2, w_median, w_mean, w_std, pairs, rescued, rejected) of ``path_widths``.

    Trapezoids between neighbours that both have a width.  For the least and the most a width within one
    deviation of the mean stays, one within two gives or takes one, others two.
    """
    w = Window.partitionBy(key).orderBy("i")
    own = F.when(F.col("valid"), F.col("w"))
    by = widths.groupBy(key).agg(F.expr("percentile(case when valid then w end, 0.5)").alias("w_median"), F.avg(own).alias("w_mean"), F.stddev_pop(own).alias("w_std"), F.count_if("rescued").alias("rescued"), F.count_if(F.col("reason") == "text_outlier").alias("rejected"))
    p = widths.select(key, "i", "x", "y", own.alias("w")).join(by, key)
    z = F.when(F.col("w_std") > 1e-6, F.abs(F.col("w") - F.col("w_mean")) / F.col("w_std")).otherwise(0.0)
    delta = F.when(z <= 1, 0.0).when(z <= 2, F.col("w_std")).otherwise(2 * F.col("w_std"))
    p = p.withColumn("lo", F.when(F.col("w").isNotNull(), F.greatest(F.lit(0.0), F.col("w") - delta))).withColumn("hi", F.col("w") + delta)
    p = p.withColumn("len", G.distance(F.col("x"), F.col("y"), F.lead("x").over(w), F.lead("y").over(w)))
    mean = lambda c: F.col("len") * 0.5 * (F.col(c) + F.lead(c).over(w))
    p = p.select(key, "len", *[mean(c).alias(c) for c in ("w", "lo", "hi")])
    area: dict[str, Column] = {name: F.coalesce(F.sum(c), F.lit(0.0)) * m_per_px**2 for name, c in (("area_m2", "w"), ("area_min_m2", "lo"), ("area_max_m2", "hi"))}
    sums = p.groupBy(key).agg((F.coalesce(F.sum("len"), F.lit(0.0)) * m_per_px).alias("length_m"), *[c.alias(n) for n, c in area.items()], F.count("w").alias("pairs"))
    return sums.join(by, key).select(key, "length_m", *area, "w_median", "w_mean", "w_std", "pairs", "rescued", "rejected")


def median_bars(widths: DataFrame, bars: int = 140, offsets: int = 10, key: str = "path_id") -> DataFrame:
    """(key, i, med_pos, med_neg, width, class, n): bars for display, at most about ``bars`` a path.

    At every ``n div bars``-th station the medians of either side over ``offsets`` stations spread evenly one stride to
    both sides; those without a width do not count, bars without any are left out.  The class tells how
    many deviations of the path's widths the bar is off their mean.
    """
    w = Window.partitionBy(key)
    own = F.when(F.col("valid"), F.col("w"))
    by = widths.groupBy(key).agg(F.count("*").alias("n"), F.avg(own).alias("mu"), F.stddev_pop(own).alias("sd"))
    p = widths.select(key, "i", "d_pos", "d_neg", "valid", (F.row_number().over(w.orderBy("i")) - 1).alias("at"))
    stride = F.greatest(F.lit(1), F.expr(f"cast(n div {bars} as int)"))
    ticks = p.join(by.select(key, "n"), key).withColumn("stride", stride).where("at % stride = 0")
    step = F.transform(F.sequence(F.lit(0), F.lit(offsets - 1)), lambda k: F.bround(-F.col("stride") + 2.0 * F.col("stride") * k / (offsets - 1)).cast("int"))
    place = F.array_distinct(F.transform(step, lambda o: F.least(F.greatest(F.col("at") + o, F.lit(0)), F.col("n").cast("int") - 1)))
    near = ticks.select(key, "i", F.explode(place).alias("at"))
    told = near.join(p.where("valid and d_pos is not null and d_neg is not null").select(key, "at", "d_pos", "d_neg"), [key, "at"])
    out = told.groupBy(key, "i").agg(F.expr("percentile(d_pos, 0.5)").alias("med_pos"), F.expr("percentile(d_neg, 0.5)").alias("med_neg"), F.count("*").alias("n"))
    out = out.join(by.select(key, "mu", "sd"), key).withColumn("width", F.col("med_pos") + F.col("med_neg"))
    z = F.when(F.col("sd") >= 1e-6, F.abs(F.col("width") - F.col("mu")) / F.col("sd")).otherwise(0.0)
    return out.select(key, "i", "med_pos", "med_neg", "width", G.sigma_class(z).alias("class"), "n")
