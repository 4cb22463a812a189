"""From a mask and a centreline to its two sides, and second looks at short widths.

Rays and candidates are exploded rows that meet the mask by place; only the choice of offsets,
each of which depends on the one before, runs in order, one path a group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.operators import curves, graph, raster, tiles
from kerbflow.operators.graph import checkpointed

PLACE = ["page", "y", "x"]
LEFT, RIGHT = 1, -1


def edge_field(mask: DataFrame, size: tuple[int, int]) -> DataFrame:
    """(page, y, x, v): the distance to the mask's edge, for its pixels and those next to it.

    The edge is what a three by three dilation has and the erosion has not; it lies at 0.
    """
    core = checkpointed(raster.eroded(mask, raster.box_kernel(3), size))
    wide = raster.dilated(mask, raster.box_kernel(3), size)
    rim = wide.join(core, PLACE, "left_anti").select(F.col("page").cast("long").alias("page"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.lit(0.0).alias("v"))
    return tiles.distances(core, size).unionByName(rim)


def cast(rays: DataFrame, mask: DataFrame, step: float, most: float) -> DataFrame:
    """(ray_id, distance): how far each ray (ray_id, page, x, y, dx, dy) stays on the mask from its first step on, up to ``most``.

    The start itself is not looked at; null if the first step is off the mask or the ray has no direction.
    """
    n = int(most / step)
    dots = rays.where((F.col("dx") != 0) | (F.col("dy") != 0)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n + 1))))
    put = lambda c: F.bround(F.col(c) + F.col(f"d{c}") * (F.col("k") * F.lit(float(step)))).cast("int")
    dots = dots.select("ray_id", "page", "k", put("y").alias("y"), put("x").alias("x"))
    on = dots.join(mask.select(*PLACE, F.lit(1).alias("on")).distinct(), PLACE, "left")
    off = on.groupBy("ray_id").agg(F.coalesce(F.min(F.when(F.col("on").isNull(), F.col("k"))), F.lit(n + 2)).alias("off"))
    return rays.select("ray_id").join(off.select("ray_id", F.when(F.col("off") > 1, F.least(F.col("off") - 1, F.lit(n)) * F.lit(float(step))).alias("distance")), "ray_id", "left")


def _rays(stations: DataFrame, key: str) -> DataFrame:
    """Both normals of each station, as rays."""
    sides = stations.withColumn("side", F.explode(F.array(F.lit(LEFT), F.lit(RIGHT))))
    return sides.withColumn("ray_id", F.struct(key, "i", "side")).withColumn("dx", F.col("nx") * F.col("side")).withColumn("dy", F.col("ny") * F.col("side"))


def side_offsets(stations: DataFrame, mask: DataFrame, field: DataFrame, most: float, step: float = 0.5, smooth: float = 0.6, bias: float = 0.01, ray_step: float = 0.5, key: str = "path_id") -> DataFrame:
    """(key, i, side, offset): how far from each station (key, i, page, x, y, nx, ny) either side of the mask lies.

    Along the normal the candidates up to the first way off the mask are weighed by their distance to the edge
    (between pixels, bilinear), by the step from the station before and by the offset itself.
    Stations without a normal or with the first step off the mask have none.
    """
    rays = checkpointed(_rays(stations, key))
    far = cast(rays.select("ray_id", "page", "x", "y", "dx", "dy"), mask, ray_step, most + ray_step)
    capped = checkpointed(rays.join(far, "ray_id"))
    counts = F.sequence(F.lit(0), F.least(F.floor(F.col("distance") / step), F.lit(math.floor(most / step + 1e-9))))
    tried = capped.where("distance > 1e-9").withColumn("k", F.explode(counts)).withColumn("offset", F.col("k") * F.lit(float(step)))
    dots = tried.select(F.struct("ray_id", "k").alias("point_id"), "page", (F.col("x") + F.col("dx") * F.col("offset")).alias("x"), (F.col("y") + F.col("dy") * F.col("offset")).alias("y"))
    cost = raster.bilinear(dots, field)
    tried = tried.join(cost, F.struct("ray_id", "k") == F.col("point_id")).select("ray_id", "offset", F.col("value").alias("cost"))
    none = capped.select("ray_id", F.col("distance").alias("cap"))
    rows = none.join(tried, "ray_id", "left").select(F.struct(F.col(f"ray_id.{key}").alias(key), F.col("ray_id.side").alias("side")).alias("line"), F.col("ray_id.i").alias("i"), "cap", F.coalesce("offset", F.lit(0.0)).alias("offset"), F.coalesce("cost", F.lit(0.0)).alias("cost"))
    named = rows.withColumn("line", F.concat_ws(":", F.col(f"line.{key}").cast("string"), F.col("line.side").cast("string")))
    fit = graph.offset_fit(named, smooth, bias, "line")
    ids = rows.select("line").distinct().select(F.concat_ws(":", F.col(f"line.{key}").cast("string"), F.col("line.side").cast("string")).alias("name"), f"line.{key}", "line.side")
    return fit.join(ids, F.col("line") == F.col("name")).select(key, "i", "side", "offset")


def recast_ends(sides: DataFrame, mask: DataFrame, neighbours: int, reach: float, ray_step: float = 0.5, key: str = "path_id") -> DataFrame:
    """The sides with their first and last points cast anew in the mean direction of their neighbours.

    ``sides`` are (key, side, i, page, x, y, sx, sy), the last two being the station's.  The mean is of the unit
    vectors from station to side of up to ``neighbours`` (two at least) stations next to the end; lines of under four points, ends without a
    direction and ends whose first step is off the mask stay.
    """
    every = Window.partitionBy(key, "side")
    p = sides.withColumn("n", F.count("*").over(every)).withColumn("k", F.greatest(F.lit(2), F.least(F.lit(int(neighbours)), F.col("n") - 2)))
    dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    size = F.sqrt(dx * dx + dy * dy)
    unit = lambda v: F.when(size >= 1e-9, v / F.when(size >= 1e-9, size))
    p = p.withColumn("ux", unit(dx)).withColumn("uy", unit(dy))
    head, tail = (F.col("i") >= 1) & (F.col("i") <= F.col("k")), (F.col("i") >= F.col("n") - 1 - F.col("k")) & (F.col("i") <= F.col("n") - 2)
    by = p.where("n >= 4").groupBy(key, "side").agg(*[F.sum(F.when(on, F.col(f"u{v}"))).alias(f"{name}{v}") for name, on in (("h", head), ("t", tail)) for v in "xy"])
    ends = p.where("n >= 4 and (i = 0 or i = n - 1)").join(by, [key, "side"])
    ends = ends.select(key, "side", "i", "page", F.col("sx").alias("x"), F.col("sy").alias("y"), *[F.when(F.col("i") == 0, F.col(f"h{v}")).otherwise(F.col(f"t{v}")).alias(f"m{v}") for v in "xy"])
    length = F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my"))
    ends = ends.withColumn("ray_id", F.struct(key, "side", "i")).where(length >= 1e-9).withColumn("dx", F.col("mx") / length).withColumn("dy", F.col("my") / length)
    far = cast(ends.select("ray_id", "page", "x", "y", "dx", "dy"), mask, ray_step, reach)
    hit = ends.join(far, "ray_id").where("distance is not null").select(key, "side", "i", (F.col("x") + F.col("dx") * F.col("distance")).alias("hx"), (F.col("y") + F.col("dy") * F.col("distance")).alias("hy"))
    return sides.join(hit, [key, "side", "i"], "left").select(key, "side", "i", "page", F.coalesce("hx", "x").alias("x"), F.coalesce("hy", "y").alias("y"), "sx", "sy")


def fitted_sides(
    centre: DataFrame, mask: DataFrame, size: tuple[int, int], spacing: float, most: float, span: int = 3, guard: int = 2, step: float = 0.5, smooth: float = 0.6, bias: float = 0.01,
    ray_step: float = 0.5, neighbours: int = 6, window: int = 1, key: str = "path_id",
) -> DataFrame:
    """(key, side, i, x, y): both sides of a mask along centrelines (key, i, page, x, y), whole.

    Stations every ``spacing``, their end included; tangents over ``span`` stations, the ends' from ``guard``
    stations inside; the offset of either side; the ends cast anew; then smoothing over ``window`` and no step
    back along the centreline.  Side 1 is to the left of the way as x goes right and y down, -1 the other.
    """
    pages = centre.groupBy(key).agg(F.min("page").alias("page"))
    stations = curves.stations_with_end(centre.select(key, "i", "x", "y"), spacing, key).select(key, F.col("station").alias("i"), "x", "y")
    stations = curves.guard_end_tangents(curves.tangents(stations, span, key), guard, key)
    stations = stations.withColumn("nx", -F.col("ty")).withColumn("ny", F.col("tx")).join(pages, key)
    stations = checkpointed(stations.select(key, F.col("i").cast("long").alias("i"), "page", "x", "y", "nx", "ny"))
    mask = checkpointed(mask.select(F.col("page").cast("long").alias("page"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).distinct())
    stations = stations.withColumn("page", F.col("page").cast("long"))
    found = side_offsets(stations, mask, checkpointed(edge_field(mask, size)), most, step, smooth, bias, ray_step, key)
    lines = stations.join(found, [key, "i"]).withColumn("d", F.coalesce("offset", F.lit(0.0)) * F.col("side"))
    lines = lines.select(key, "side", "i", "page", (F.col("x") + F.col("nx") * F.col("d")).alias("x"), (F.col("y") + F.col("ny") * F.col("d")).alias("y"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    lines = checkpointed(recast_ends(checkpointed(lines), mask, neighbours, math.hypot(*size), ray_step, key))
    lines = lines.withColumn("line", F.concat_ws(":", F.col(key).cast("string"), F.col("side").cast("string")))
    names = lines.select("line", key, "side").distinct()
    smoothed = curves.smooth_padded(lines.select("line", "i", "x", "y"), window, key="line").select("line", "i", F.col("x_smooth").alias("x"), F.col("y_smooth").alias("y"))
    centres = lines.select("line", "i", F.col("sx").alias("x"), F.col("sy").alias("y"))
    out = graph.progress_along(smoothed, centres, "line")
    return out.join(names, "line").select(key, "side", "i", "x", "y")


def ends_extended(lines: DataFrame, mask: DataFrame, lookahead: int = 8, step: float = 0.5, most: float = 1000.0, key: str = "path_id") -> DataFrame:
    """(key, i, x, y): lines (key, i, page, x, y) with both ends carried on to the edge of the mask, a point every pixel or so.

    An end goes on in the direction from the point ``lookahead`` before it; lines of under three points stay.
    """
    w = Window.partitionBy(key).orderBy("i")
    p = lines.select(key, "page", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.row_number().over(w) - 1).cast("long").alias("i"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    k = F.greatest(F.lit(1), F.least(F.lit(int(lookahead)), F.col("n") - 1))
    at = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    p = checkpointed(p.withColumn("k", k))
    ends = p.where("n >= 3").groupBy(key).agg(F.first("page").alias("page"), F.first("n").alias("n"), *[at(i, c).alias(f"{name}{c}") for name, i in (("s", F.lit(0)), ("sr", F.col("k")), ("e", F.col("n") - 1), ("er", F.col("n") - 1 - F.col("k"))) for c in "xy"])
    tip = lambda name, sign: F.struct(F.lit(sign).alias("end"), *[F.col(f"{name}{c}").alias(c) for c in "xy"], *[(F.col(f"{name}{c}") - F.col(f"{name}r{c}")).alias(f"d{c}") for c in "xy"])
    tips = ends.select(key, "page", "n", F.explode(F.array(tip("s", -1), tip("e", 1))).alias("t")).select(key, "page", "n", "t.*")
    size = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    rays = tips.where(size > 1e-9).select(key, "page", "n", "end", "x", "y", (F.col("dx") / size).alias("dx"), (F.col("dy") / size).alias("dy")).withColumn("ray_id", F.struct(key, "end"))
    far = rays.join(cast(rays.select("ray_id", "page", "x", "y", "dx", "dy"), mask, step, most), "ray_id").where("distance > 1e-6")
    far = far.withColumn("m", F.greatest(F.lit(2), F.bround("distance").cast("int"))).withColumn("j", F.explode(F.sequence(F.lit(1), F.col("m"))))
    along = F.col("distance") * F.col("j") / F.col("m")
    more = far.select(key, F.when(F.col("end") < 0, -F.col("j")).otherwise(F.col("n") - 1 + F.col("j")).cast("long").alias("i"), (F.col("x") + F.col("dx") * along).alias("x"), (F.col("y") + F.col("dy") * along).alias("y"))
    out = p.select(key, "i", "x", "y").unionByName(more)
    return out.select(key, (F.row_number().over(w) - 1).cast("long").alias("i"), "x", "y")


# -- widths -------------------------------------------------------------------------------------


def station_widths(samples: DataFrame, support: DataFrame, black: DataFrame, size: tuple[int, int], most: float, step: float = 1.0, black_run: int = 1, outside_run: int = 1, grace: float = 80.0, key: str = "path_id") -> DataFrame:
    """(key, i, page, x, y, d_pos, d_neg, w, reason): the way to a boundary on either side of each point (key, i, page, x, y).

    The tangents come from the neighbours' places ``rx``, ``ry`` before snapping, where the points have them.  Points off the support, and those whose neighbours lie in one place, have no width; nor have those with a side that meets nothing.
    """
    w = Window.partitionBy(key).orderBy("i")
    around = lambda c: F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))
    raw = ["rx", "ry"] if "rx" in samples.columns else ["x", "y"]
    p = samples.select(key, F.col("i").cast("long").alias("i"), F.col("page").cast("long").alias("page"), *[F.col(c).cast("double").alias(n) for c, n in zip(["x", "y", *raw], ["x", "y", "rx", "ry"])])
    p = p.withColumn("dx", around("rx")).withColumn("dy", around("ry")).withColumn("norm", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    at = p.withColumn("fy", F.bround("y").cast("int")).withColumn("fx", F.bround("x").cast("int"))
    held = support.select(F.col("page").cast("long").alias("page"), F.col("y").cast("int").alias("fy"), F.col("x").cast("int").alias("fx"), F.lit(True).alias("held")).distinct()
    at = at.join(held, ["page", "fy", "fx"], "left")
    reason = F.when(F.col("held").isNull(), "center_not_on_support").when(F.col("norm") < 1e-6, "zero_tangent")
    at = checkpointed(at.select(key, "i", "page", "x", "y", reason.alias("reason"), (-F.col("dy") / F.nullif("norm", F.lit(0.0))).alias("nx"), (F.col("dx") / F.nullif("norm", F.lit(0.0))).alias("ny")))
    rays = _rays(at.where("reason is null"), key)
    far = raster.rays_to_black(rays.select("ray_id", "page", "x", "y", "dx", "dy"), support, black, size, most, step, black_run, outside_run, grace)
    by = far.groupBy(F.col(f"ray_id.{key}").alias(key), F.col("ray_id.i").alias("i")).agg(*[F.max(F.when(F.col("ray_id.side") == s, F.col("distance"))).alias(name) for s, name in ((1, "d_pos"), (-1, "d_neg"))])
    return at.join(by, [key, "i"], "left").select(key, "i", "page", "x", "y", "d_pos", "d_neg", (F.col("d_pos") + F.col("d_neg")).alias("w"), "reason")


def rescued_widths(
    widths: DataFrame, support: DataFrame, black: DataFrame, size: tuple[int, int], most: float, step: float = 1.0, low_sigma: float = 0.5, extra_sigma: float = 1.0, ratio: float = 0.6,
    black_run: int = 1, outside_run: int = 1, rounds: int = 1, key: str = "path_id",
) -> DataFrame:
    """``station_widths`` with a second look at widths under the median less ``low_sigma`` deviations of their path.

    Either side looks on for ``extra_sigma`` deviations beyond its boundary, no further than ``most``.  If that window is mostly support,
    the boundary moves to the next one in it, or to its end.  Paths of under six widths stay.  Later
    rounds, if asked for, look at what is still short after the one before, until nothing grows; ``rescued``
    tells which widths grew.  No station is lost.
    """
    w = Window.partitionBy(key).orderBy("i")
    around = lambda c: F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))
    now = widths.withColumn("dx", around("x")).withColumn("dy", around("y")).withColumn("norm", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    unit = lambda v: v / F.nullif("norm", F.lit(0.0))
    now = now.withColumn("nx", unit(-F.col("dy"))).withColumn("ny", unit(F.col("dx"))).withColumn("rescued", F.lit(False)).drop("dx", "dy")
    columns = [key, "i", "page", "x", "y", "d_pos", "d_neg", "w", "reason", "rescued", "norm", "nx", "ny"]
    now = checkpointed(now.select(*columns))
    for _ in range(rounds):
        by = now.groupBy(key).agg(F.count("w").alias("n"), F.expr("percentile(w, 0.5)").alias("med"), F.stddev_pop("w").alias("sd")).where("n > 5")
        short = now.join(by, key).where((F.col("w") < F.col("med") - low_sigma * F.col("sd")) & (F.col("norm") >= 1e-6))
        short = short.withColumn("extra", F.greatest(F.lit(float(step)), extra_sigma * F.col("sd")))
        rays = _rays(short, key).withColumn("d", F.when(F.col("side") == 1, F.col("d_pos")).otherwise(F.col("d_neg")))
        rays = rays.withColumn("t0", F.col("d") + step).withColumn("t1", F.least(F.lit(float(most)), F.col("d") + F.col("extra"))).where("t1 > t0")
        rays = checkpointed(rays.select("ray_id", "page", "x", "y", "dx", "dy", "d", F.col("t0").alias("from"), F.col("t1").alias("to")))
        seen = raster.boundary_in_window(rays, support, black, size, F.col("from"), F.col("to"), step, black_run, outside_run)
        grown = rays.join(seen, "ray_id").where(F.col("support") >= ratio).select("ray_id", F.when(F.col("distance").isNull(), F.col("to")).otherwise(F.greatest("d", "distance")).alias("far"))
        side = lambda s, name: F.max(F.when(F.col("ray_id.side") == s, F.col("far"))).alias(name)
        grown = grown.groupBy(F.col(f"ray_id.{key}").alias(key), F.col("ray_id.i").alias("i")).agg(side(1, "g_pos"), side(-1, "g_neg"))
        out = now.join(grown, [key, "i"], "left").withColumn("g_pos", F.coalesce("g_pos", "d_pos")).withColumn("g_neg", F.coalesce("g_neg", "d_neg"))
        grew = F.coalesce(F.col("g_pos") + F.col("g_neg") > F.col("w") + 1e-6, F.lit(False))
        take = lambda new, old: F.when(F.col("grew"), F.col(new)).otherwise(F.col(old)).alias(old)
        out = out.withColumn("grew", grew).withColumn("g_w", F.col("g_pos") + F.col("g_neg"))
        out = checkpointed(out.select(key, "i", "page", "x", "y", take("g_pos", "d_pos"), take("g_neg", "d_neg"), take("g_w", "w"), "reason", (F.col("rescued") | F.col("grew")).alias("rescued"), "norm", "nx", "ny", "grew"))
        now = out.drop("grew")
        if rounds > 1 and out.where("grew").isEmpty():
            break
    return now.drop("norm", "nx", "ny")

