"""Masks as sparse tables of set pixels (page, y, x), and operators on them.

Neighbourhoods are equi-joins: pixels are moved by each offset of a kernel and met again
by place.  Ordered pixel algorithms run as one grouped numpy function a page.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.functions import geometry as G
from kerbflow.operators import graph, spatial

PLACE = ["page", "y", "x"]


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*PLACE).union(b.select(*PLACE)).distinct()


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*PLACE).distinct().join(b.select(*PLACE).distinct(), PLACE, "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*PLACE).distinct().join(b.select(*PLACE).distinct(), PLACE, "left_anti")


def box_kernel(size: int) -> list[tuple[int, int]]:
    """Offsets of a square; an even size reaches one further to the upper left."""
    a, b = -(size // 2), size - size // 2
    return [(dy, dx) for dy in range(a, b) for dx in range(a, b)]


def ellipse_kernel(size: int) -> list[tuple[int, int]]:
    r = size // 2
    return [(dy, dx) for dy, dx in box_kernel(size) if r == 0 or dy * dy + dx * dx <= r * r]


def _moved(mask: DataFrame, kernel, sign: int) -> DataFrame:
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in kernel])
    p = mask.select(*PLACE).distinct().withColumn("o", F.explode(offsets))
    return p.select("page", (F.col("y") + sign * F.col("o.dy")).alias("y"), (F.col("x") + sign * F.col("o.dx")).alias("x"))


def _inside(mask: DataFrame, size: tuple[int, int] | None) -> DataFrame:
    return mask if size is None else mask.where((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < size[0]) & (F.col("x") < size[1]))


def dilated(mask: DataFrame, kernel, size: tuple[int, int] | None = None) -> DataFrame:
    return _inside(_moved(mask, kernel, 1), size).distinct()


def eroded(mask: DataFrame, kernel, size: tuple[int, int] | None = None) -> DataFrame:
    """Pixels all of whose kernel is set; places outside the image do not count against them."""
    hits = _moved(mask, kernel, -1).groupBy(*PLACE).agg(F.count("*").alias("hits"))
    need: Column = F.lit(len(kernel))
    if size is not None:
        inside = [((F.col("y") + dy >= 0) & (F.col("y") + dy < size[0]) & (F.col("x") + dx >= 0) & (F.col("x") + dx < size[1])).cast("int") for dy, dx in kernel]
        need = sum(inside[1:], inside[0])
    return _inside(hits, size).where(F.col("hits") == need).select(*PLACE)


def opened(mask: DataFrame, kernel, size=None) -> DataFrame:
    return dilated(eroded(mask, kernel, size), kernel, size)


def closed(mask: DataFrame, kernel, size=None) -> DataFrame:
    return eroded(dilated(mask, kernel, size), kernel, size)


def local_maxima(field: DataFrame, least: float) -> DataFrame:
    """Pixels (page, y, x, v) that no neighbour of the eight exceeds, of at least ``least``."""
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in box_kernel(3)])
    spread = field.withColumn("o", F.explode(offsets)).select("page", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "v")
    top = spread.groupBy(*PLACE).agg(F.max("v").alias("top"))
    return field.where(F.col("v") >= least).join(top, PLACE).where("v >= top").select(*PLACE, "v")


def component_stats(labelled: DataFrame) -> DataFrame:
    """Box, area, aspect and fill of each component of pixels (page, component, y, x)."""
    by = labelled.groupBy("page", "component").agg(F.count("*").alias("area"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    return by.withColumn("aspect", F.greatest("w", "h") / F.least("w", "h")).withColumn("fill", F.col("area") / (F.col("w") * F.col("h")))


def keep_reason(stats: DataFrame, least: int, most: int, aspect: float, fill: float) -> DataFrame:
    reason = F.when(F.col("area") < least, "too_small").when(F.col("area") > most, "too_large").when((F.col("aspect") < aspect) & (F.col("fill") > fill), "blob_like").otherwise("keep")
    return stats.withColumn("keep_reason", reason).withColumn("keep", F.col("keep_reason") == "keep")


def ribbon_score(stats: DataFrame) -> DataFrame:
    """Long thin components score high."""
    span, thick = F.greatest("w", "h"), F.least("w", "h")
    return stats.withColumn("score", span * (1 + 0.15 * F.log(F.greatest("area", F.lit(2)))) - 0.4 * thick)


def color_mask(pixels: DataFrame, color: tuple[int, int, int], threshold: float) -> DataFrame:
    r, g, b = (F.col(c) - v for c, v in zip("rgb", color))
    return pixels.where(F.sqrt(r * r + g * g + b * b) <= threshold).select(*PLACE)


def clear_rects(mask: DataFrame, rects: DataFrame) -> DataFrame:
    """Pixels outside the page's rectangles."""
    dots = mask.select("page", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    covered = spatial.overlap_pairs(dots.distinct(), rects.select("page", "x0", "y0", "x1", "y1"), 64.0)
    covered = covered.select(F.col("a_page").alias("page"), F.col("a_y0").alias("y"), F.col("a_x0").alias("x")).distinct()
    return mask.join(covered, PLACE, "left_anti")


def first_drawn(drawings: DataFrame) -> DataFrame:
    """The least drawing_id over each pixel of the drawings' boxes (page, x0..y1 in pixels)."""
    slim = graph.spread(drawings.select("page", "drawing_id", "x0", "y0", "x1", "y1"))
    rows = slim.withColumn("y", F.explode(F.sequence(F.col("y0").cast("int"), F.col("y1").cast("int"))))
    rows = rows.withColumn("x", F.explode(F.sequence(F.col("x0").cast("int"), F.col("x1").cast("int"))))
    return rows.groupBy(*PLACE).agg(F.min("drawing_id").alias("first_id"))


def marched(rays: DataFrame, mask: DataFrame, step: float, most: float) -> DataFrame:
    """Along rays (ray_id, page, x, y, dx, dy): the last distance before the mask is left, and the first outside.

    Both are null where the ray starts outside, the second where it does not leave within ``most``.
    """
    n = int(most / step)
    dots = rays.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("t", F.col("k") * F.lit(step))
    put = lambda c: F.bround(F.col(c) + F.col(f"d{c}") * F.col("t")).cast("int")
    dots = dots.select("ray_id", "page", "t", put("y").alias("y"), put("x").alias("x"))
    on = dots.join(mask.select(*PLACE, F.lit(1).alias("on")).distinct(), PLACE, "left")
    out = F.min(F.when(F.col("on").isNull(), F.col("t")))
    by = on.groupBy("ray_id").agg(out.alias("first_outside"), F.max("t").alias("reach"))
    starts = F.coalesce("first_outside", F.lit(-1.0)) != 0
    return by.select("ray_id", F.when(starts, F.coalesce(F.col("first_outside") - step, F.col("reach"))).alias("last_inside"), F.when(starts, F.col("first_outside")).alias("first_outside"))


def first_black(rays: DataFrame, black: DataFrame, step: float, most: float, run: int) -> DataFrame:
    """The first distance along each ray from which ``run`` steps in a row are black; null if there is none."""
    dots = rays.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(int(most / step)))))
    put = lambda c: F.bround(F.col(c) + F.col(f"d{c}") * F.col("k") * F.lit(step)).cast("int")
    dots = dots.select("ray_id", "page", "k", put("y").alias("y"), put("x").alias("x"))
    on = dots.join(black.select(*PLACE).distinct(), PLACE)
    island = F.col("k") - F.row_number().over(Window.partitionBy("ray_id").orderBy("k"))
    runs = on.withColumn("island", island).groupBy("ray_id", "island").agg(F.min("k").alias("k"), F.count("*").alias("n")).where(F.col("n") >= run)
    first = runs.groupBy("ray_id").agg((F.min("k") * F.lit(step)).alias("distance"))
    return rays.select("ray_id").join(first, "ray_id", "left")


def _walks(rays: DataFrame, support: DataFrame, black: DataFrame, size: tuple[int, int], step: float, start: Column, end: Column) -> DataFrame:
    """The steps of rays (ray_id, page, x, y, dx, dy) from ``start`` to ``end``, with the run of black and of unsupported pixels that each ends.

    (ray_id, n, t, inside, black, black_from, black_run, out_from, out_run): runs are known by
    the step they begin at.  Each ray is walked by windows over its own steps.
    """
    count = F.floor((end - start) / step).cast("int")
    some = F.when(count >= 0, F.sequence(F.lit(0), count)).otherwise(F.array().cast("array<int>"))
    dots = rays.withColumn("t0", start).withColumn("n", F.explode(some)).withColumn("t", F.col("t0") + F.col("n") * F.lit(float(step)))
    put = lambda c: F.bround(F.col(c) + F.col(f"d{c}") * F.col("t")).cast("int")
    dots = dots.select("ray_id", "page", "n", "t", put("y").alias("y"), put("x").alias("x"))
    inside = (F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < size[0]) & (F.col("x") < size[1])
    on = lambda df, mask, name: df.join(mask.select(*PLACE, F.lit(True).alias(name)).distinct(), PLACE, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    dots = on(on(dots.withColumn("inside", inside), support, "held"), black, "black")
    so_far = Window.partitionBy("ray_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = lambda still: F.coalesce(F.max(F.when(~still, F.col("n"))).over(so_far), F.lit(-1)) + 1
    dots = dots.withColumn("black_from", first(F.col("black"))).withColumn("out_from", first(~F.col("held")))
    runs = dots.withColumn("black_run", F.col("n") - F.col("black_from") + 1).withColumn("out_run", F.col("n") - F.col("out_from") + 1)
    return runs.select("ray_id", "n", "t", "inside", "held", "black", "black_from", "black_run", "out_from", "out_run")


def _events(walks: DataFrame, black_run: int, outside_run: int) -> DataFrame:
    """By ray: the step that leaves the image, the first full run of black, the first full run off the support, and the last step."""
    hit = F.col("black") & (F.col("black_run") >= max(1, black_run))
    out = ~F.col("held") & (F.col("out_run") >= max(1, outside_run))
    return walks.groupBy("ray_id").agg(
        F.min(F.when(~F.col("inside"), F.col("n"))).alias("leave"), F.min(F.when(hit, F.struct("n", F.col("black_from").alias("begin")))).alias("hit"),
        F.min(F.when(out, F.struct("n", F.col("out_from").alias("begin")))).alias("out"), F.max("n").alias("last"), F.min("t").alias("t0"),
    )


def rays_to_black(rays: DataFrame, support: DataFrame, black: DataFrame, size: tuple[int, int], most: float, step: float = 1.0, black_run: int = 1, outside_run: int = 1, grace: float = 80.0) -> DataFrame:
    """(ray_id, distance) at which each ray meets a boundary: a run of black, else the end of the support, else the image's edge; null if none.

    A ray that has left the support goes on for ``grace``, because a drawn line may lie just outside.
    """
    walks = _walks(rays, support, black, size, step, F.lit(float(step)), F.lit(float(most)))
    e = _events(walks, black_run, outside_run)
    wait = F.greatest(F.col("out.n"), F.ceil(F.col("out.begin") + F.lit(grace / step)).cast("int"))
    e = e.withColumn("stop", F.when(F.col("out").isNotNull() & (wait <= F.col("last")), wait))
    e = e.withColumn("at", F.coalesce("stop", "last"))
    there = walks.select("ray_id", F.col("n").alias("at"), F.col("black").alias("at_black"), F.col("black_from").alias("at_from"))
    e = e.join(there, ["ray_id", "at"], "left")
    before = lambda a, b: F.col(a).isNotNull() & (F.col(b).isNull() | (F.col(a) <= F.col(b)))
    leaves = before("leave", "hit.n") & before("leave", "stop")
    put = lambda n: F.col("t0") + n * F.lit(float(step))
    far = F.when(leaves, put(F.col("leave"))).when(before("hit.n", "stop"), put(F.col("hit.begin"))).when(F.col("at_black"), put(F.col("at_from"))).otherwise(put(F.col("out.begin")))
    return rays.select("ray_id").join(e.select("ray_id", far.alias("distance")), "ray_id", "left")


def boundary_in_window(rays: DataFrame, support: DataFrame, black: DataFrame, size: tuple[int, int], t0: Column, t1: Column, step: float = 1.0, black_run: int = 1, outside_run: int = 1) -> DataFrame:
    """(ray_id, distance, support): the first boundary between two distances of each ray, and the share of supported steps that are not black."""
    walks = _walks(rays, support, black, size, step, F.greatest(F.lit(float(step)), t0), t1)
    good = F.avg(F.when(F.col("inside"), (F.col("held") & ~F.col("black")).cast("double")))
    e = _events(walks, black_run, outside_run).join(walks.groupBy("ray_id").agg(good.alias("support")), "ray_id")
    before = lambda a, *rest: F.col(a).isNotNull() & (F.col(a) <= F.least(F.col(a), *[F.coalesce(F.col(r), F.col(a)) for r in rest]))
    put = lambda n: F.col("t0") + n * F.lit(float(step))
    far = F.when(before("leave", "hit.n", "out.n"), put(F.col("leave"))).when(before("hit.n", "out.n"), put(F.col("hit.begin"))).otherwise(put(F.col("out.begin")))
    return rays.select("ray_id").join(e.select("ray_id", far.alias("distance"), "support"), "ray_id", "left").withColumn("support", F.coalesce("support", F.lit(0.0)))


def bilinear(points: DataFrame, field: DataFrame, outside: float = 1e6) -> DataFrame:
    """Values of ``field`` (page, y, x, v) between pixels at points (point_id, page, x, y)."""
    corner = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    p = points.withColumn("fx", F.floor("x")).withColumn("fy", F.floor("y")).withColumn("c", F.explode(corner))
    share = lambda v, f, c: F.when(F.col(c) == 1, F.col(v) - F.col(f)).otherwise(1 - (F.col(v) - F.col(f)))
    p = p.select("point_id", "page", (F.col("fy") + F.col("c.a")).cast("int").alias("y"), (F.col("fx") + F.col("c.b")).cast("int").alias("x"), (share("y", "fy", "c.a") * share("x", "fx", "c.b")).alias("share"))
    hit = p.join(field.select(*PLACE, "v"), PLACE, "left").where("share > 0")
    whole = F.count("v") == F.count(F.lit(1))
    return hit.groupBy("point_id").agg(F.when(whole, F.sum(F.col("share") * F.col("v"))).otherwise(outside).alias("value"))


def thick_path(segments: DataFrame) -> DataFrame:
    """Pixels within half the width of segments (page, ax, ay, bx, by, width)."""
    r = F.greatest(F.col("width") / 2, F.lit(1.0))
    low = lambda a, b: F.ceil(F.least(a, b) - r)
    high = lambda a, b: F.floor(F.greatest(a, b) + r)
    rows = segments.withColumn("y", F.explode(F.sequence(low("ay", "by"), high("ay", "by")))).withColumn("x", F.explode(F.sequence(low("ax", "bx"), high("ax", "bx"))))
    d = G.segment_distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return rows.where(d <= r).select("page", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).distinct()


def _grids(pdf: pd.DataFrame, pad: int = 1) -> tuple[np.ndarray, int, int]:
    y0, x0 = int(pdf["y"].min()) - pad, int(pdf["x"].min()) - pad
    grid = np.zeros((int(pdf["y"].max()) - y0 + pad + 1, int(pdf["x"].max()) - x0 + pad + 1), bool)
    grid[pdf["y"].to_numpy(int) - y0, pdf["x"].to_numpy(int) - x0] = True
    return grid, y0, x0


def distance_transform(mask: DataFrame) -> DataFrame:
    """The exact distance of each set pixel to the nearest one that is not set, a page at a time.

    A task holds the page's bounding box of pixels, some 40 bytes each.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid, y0, x0 = _grids(pdf)
        # along the columns: steps since the last pixel that is not set, from either side
        row = np.arange(len(grid))[:, None]
        above = np.maximum.accumulate(np.where(grid, -1, row), axis=0)
        below = np.minimum.accumulate(np.where(grid, 2 * len(grid), row)[::-1], axis=0)[::-1]
        column = np.minimum(row - above, below - row).astype(np.int64) ** 2
        # along the rows: a shift by d adds d * d, so none beyond the largest distance counts
        full, d = column.copy(), 1
        while d * d < full.max(initial=0) and d < full.shape[1]:
            np.minimum(full[:, d:], column[:, :-d] + d * d, out=full[:, d:])
            np.minimum(full[:, :-d], column[:, d:] + d * d, out=full[:, :-d])
            d += 1
        y, x = np.nonzero(grid)
        return pd.DataFrame({"page": pdf["page"].iloc[0], "y": y + y0, "x": x + x0, "v": np.sqrt(full[y, x])})

    return mask.select(*PLACE).distinct().groupBy("page").applyInPandas(run, "page int, y int, x int, v double")


def skeleton(mask: DataFrame) -> DataFrame:
    """Thinning in two alternating passes until nothing changes, a page at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid, y0, x0 = _grids(pdf)
        g = grid.astype(np.uint8)
        while True:
            before = int(g.sum())
            for side in (0, 1):
                p = [np.roll(np.roll(g, dy, 0), dx, 1) for dy, dx in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]
                n = sum(p)
                turns = sum((p[k] == 0) & (p[(k + 1) % 8] == 1) for k in range(8))
                open_side = (p[0] * p[2] * p[4] == 0) & (p[2] * p[4] * p[6] == 0) if side == 0 else (p[0] * p[2] * p[6] == 0) & (p[0] * p[4] * p[6] == 0)
                g = np.where((g == 1) & (n >= 2) & (n <= 6) & (turns == 1) & open_side, 0, g).astype(np.uint8)
            if int(g.sum()) == before:
                break
        y, x = np.nonzero(g)
        return pd.DataFrame({"page": pdf["page"].iloc[0], "y": y + y0, "x": x + x0})

    return mask.select(*PLACE).distinct().groupBy("page").applyInPandas(run, "page int, y int, x int")


def filled_polygons(corners: DataFrame) -> DataFrame:
    """Pixels whose centres lie inside polygons (page, polygon_id, i, x, y), by the even-odd rule.

    Every edge gives its crossing of each pixel row; crossings are paired by rank.
    """
    w = Window.partitionBy("page", "polygon_id").orderBy("i")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = corners.withColumn("bx", F.coalesce(F.lead("x").over(w), F.first("x").over(every))).withColumn("by", F.coalesce(F.lead("y").over(w), F.first("y").over(every)))
    first, last = F.ceil(F.least("y", "by")), F.ceil(F.greatest("y", "by")) - 1
    e = e.withColumn("row", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    at = F.col("x") + (F.col("bx") - F.col("x")) * (F.col("row") - F.col("y")) / (F.col("by") - F.col("y"))
    cross = e.select("page", "polygon_id", "row", at.alias("at"))
    order = Window.partitionBy("page", "polygon_id", "row").orderBy("at")
    spans = cross.withColumn("n", F.row_number().over(order)).withColumn("end", F.lead("at").over(order)).where("n % 2 = 1 and end is not null")
    a, b = F.ceil("at"), F.floor("end")
    out = spans.withColumn("x", F.explode(F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))))
    return out.select("page", F.col("row").cast("int").alias("y"), F.col("x").cast("int").alias("x")).distinct()


def drawn_pixels(polygons: DataFrame, boxes: DataFrame, strokes: DataFrame) -> DataFrame:
    """The pixels of drawings: filled polygons (page, polygon_id, i, x, y), boxes (page, x0, y0, x1, y1) with their edges, and strokes (page, ax, ay, bx, by, width)."""
    span = lambda c: F.explode(F.sequence(F.least(F.bround(f"{c}0"), F.bround(f"{c}1")).cast("int"), F.greatest(F.bround(f"{c}0"), F.bround(f"{c}1")).cast("int")))
    filled = boxes.withColumn("y", span("y")).withColumn("x", span("x")).select(*PLACE)
    return filled_polygons(polygons).unionByName(filled).unionByName(thick_path(strokes)).distinct()


def small_removed(labelled: DataFrame, least: int) -> DataFrame:
    """Pixels of components with at least so many; of the set ones objects go, of the others holes."""
    keep = labelled.groupBy("page", "component").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("page", "component")
    return labelled.join(keep, ["page", "component"], "left_semi")


def enclosed(labelled: DataFrame, size: tuple[int, int]) -> DataFrame:
    """Of labelled background pixels, those of components that do not touch the image's border."""
    border = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == size[0] - 1) | (F.col("x") == size[1] - 1)
    return labelled.join(labelled.where(border).select("page", "component").distinct(), ["page", "component"], "left_anti")


def largest_filled(mask: DataFrame, kernel: int, size: tuple[int, int]) -> DataFrame:
    """Of each page the largest component (eight neighbours), its holes filled, after closing with an ellipse of an odd size.

    Of equally large ones the one whose first pixel by (y, x) comes first.  Holes are the
    background components (four neighbours) that do not reach the image's edge.
    """
    k = max(1, kernel) | 1
    whole = graph.checkpointed(closed(mask, ellipse_kernel(k), size) if k > 1 else mask.select(*PLACE).distinct())
    holes = enclosed(graph.labelled(difference(graph.every_place(whole, size), whole), 4), size)
    full = graph.labelled(union(whole, holes), 8)
    top = full.groupBy("page", "component").agg(F.count("*").alias("n")).groupBy("page").agg(F.min(F.struct(-F.col("n"), "component")).alias("t")).select("page", F.col("t.component").alias("component"))
    return full.join(top, ["page", "component"], "left_semi").select(*PLACE)


def cost_map(pixels: DataFrame, support: DataFrame, overlay: DataFrame) -> DataFrame:
    """What a step costs on each pixel: 8 in the open, 1.2 on support, 0.35 on the overlay."""
    p = pixels.select(*PLACE).distinct()
    p = p.join(support.select(*PLACE, F.lit(1).alias("s")).distinct(), PLACE, "left").join(overlay.select(*PLACE, F.lit(1).alias("o")).distinct(), PLACE, "left")
    return p.select(*PLACE, F.when(F.col("o") == 1, 0.35).when(F.col("s") == 1, 1.2).otherwise(8.0).alias("cost"))


def reconstructed(mask: DataFrame, limits: DataFrame, half_width: int) -> DataFrame:
    """The mask widened by half a width, inside its limits, with small gaps closed."""
    return closed(common(dilated(mask, ellipse_kernel(2 * half_width + 1)), limits), box_kernel(3))


def support_ratio(rays: DataFrame, mask: DataFrame, start: int, end: int) -> DataFrame:
    """The share of set pixels among the steps ``start`` to ``end`` of each ray."""
    dots = rays.withColumn("k", F.explode(F.sequence(F.lit(start), F.lit(end))))
    put = lambda c: F.bround(F.col(c) + F.col(f"d{c}") * F.col("k")).cast("int")
    dots = dots.select("ray_id", "page", put("y").alias("y"), put("x").alias("x"))
    on = dots.join(mask.select(*PLACE, F.lit(1).alias("on")).distinct(), PLACE, "left")
    return on.groupBy("ray_id").agg(F.avg(F.coalesce("on", F.lit(0)).cast("double")).alias("support"))


def touching_absorbed(fragments: DataFrame, start: int = 0) -> DataFrame:
    """Fragments (page, component, y, x) that meet the growing whole when it is widened by two, in order of label.

    The whole begins with the component ``start`` of each page; a fragment that is absorbed
    counts for those after it.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = set(zip(*(pdf.loc[pdf["component"] == start, c] for c in ("y", "x"))))
        taken = [start]
        for label, part in sorted((k, g) for k, g in pdf.groupby("component") if k != start):
            own = set(zip(part["y"], part["x"]))
            if any((y + dy, x + dx) in whole for y, x in own for dy in range(-2, 3) for dx in range(-2, 3)):
                whole |= own
                taken.append(label)
        return pd.DataFrame({"page": pdf["page"].iloc[0], "component": taken})

    slim = fragments.select("page", F.col("component").cast("long").alias("component"), "y", "x")
    return slim.groupBy("page").applyInPandas(run, "page int, component long")


def contours(labelled: DataFrame) -> DataFrame:
    """The outer outline of each component (page, component, y, x), in order, clockwise from its topmost leftmost pixel.

    A component is within one task, which walks around many of them.
    """
    ring = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]

    def outline(y, x):
        here = set(zip(y.tolist(), x.tolist()))
        start = min(here)
        walk, at, came, first = [start], start, 4, None
        while True:
            for k in range(1, 9):
                side = (came + k) % 8
                step = (at[0] + ring[side][0], at[1] + ring[side][1])
                if step in here:
                    break
            else:
                break  # a single pixel
            if first is None:
                first = (at, step)
            elif (at, step) == first:
                walk.pop()
                break
            walk.append(step)
            at, came = step, (side + 4) % 8
        return walk

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page", "component"])
        page, component, y, x = (pdf[c].to_numpy() for c in ("page", "component", "y", "x"))
        cuts = np.flatnonzero((page[1:] != page[:-1]) | (component[1:] != component[:-1])) + 1
        walks = [outline(*part) for part in zip(np.split(y, cuts), np.split(x, cuts))]
        n = np.array([len(w) for w in walks])
        first = np.repeat(np.r_[0, cuts], n)
        at = np.concatenate([np.array(w) for w in walks])
        i = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        return pd.DataFrame({"page": page[first], "component": component[first], "i": i, "y": at[:, 0], "x": at[:, 1]})

    slim = labelled.select(F.col("page").cast("long").alias("page"), F.col("component").cast("long").alias("component"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    return graph.dealt(slim, "page", "component", rows=graph.PIXELS).applyInPandas(run, "page long, component long, i int, y int, x int")
