"""Joins by place: overlap, radius, nearest, with grid cells as equi-join keys.

A theta join alone is a nested loop.  Boxes are dealt into the cells of a grid, joined by
cell, and each pair is kept in the one cell that holds the corner of its common part, so
that no pair has to be made distinct afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.functions import geometry as G
from kerbflow.operators.graph import MANY, checkpointed, spread

#: Places that a smallest cell of the search may hold, and the levels of cells at most.
LEAF, DEEPEST = 64, 16


def _cells(df: DataFrame, p: str, size: float, pad: float) -> DataFrame:
    low = lambda c: F.floor((F.col(f"{p}{c}") - pad) / size)
    high = lambda c: F.floor((F.col(f"{p}{c}") + pad) / size)
    df = df.withColumn("gx", F.explode(F.sequence(low("x0"), high("x1"))))
    return df.withColumn("gy", F.explode(F.sequence(low("y0"), high("y1"))))


def _boxes(df: DataFrame, p: str) -> DataFrame:
    return df.select([F.col(c).alias(p + c) for c in df.columns])


def overlap_pairs(left: DataFrame, right: DataFrame, cell: float, gap: float = 0.0, on: str = "page") -> DataFrame:
    """Pairs of boxes of one page that meet once widened by ``gap``; columns prefixed a_ and b_."""
    a = _cells(spread(_boxes(left, "a_")), "a_", cell, gap / 2)
    b = _cells(spread(_boxes(right, "b_")), "b_", cell, gap / 2)
    b = b.withColumnRenamed("gx", "hx").withColumnRenamed("gy", "hy")
    same = (F.col(f"a_{on}") == F.col(f"b_{on}")) & (F.col("gx") == F.col("hx")) & (F.col("gy") == F.col("hy"))
    corner = lambda c: F.floor(F.greatest(F.col(f"a_{c}0") - gap / 2, F.col(f"b_{c}0") - gap / 2) / cell)
    meet = G.boxes_overlap("a_", "b_", gap)
    return a.join(b, same & meet & (F.col("gx") == corner("x")) & (F.col("gy") == corner("y"))).drop("gx", "gy", "hx", "hy")


def self_overlap_pairs(boxes: DataFrame, cell: float, gap: float = 0.0, id_column: str = "drawing_id", on: str = "page") -> DataFrame:
    """Undirected pairs (a < b) of ids."""
    slim = boxes.select(id_column, on, "x0", "y0", "x1", "y1")
    pairs = overlap_pairs(slim, slim, cell, gap, on).where(F.col(f"a_{id_column}") < F.col(f"b_{id_column}"))
    return pairs.select(F.col(f"a_{id_column}").alias("a"), F.col(f"b_{id_column}").alias("b"))


def radius_pairs(points: DataFrame, radius: float, id_column: str, on: str = "page") -> DataFrame:
    """Undirected pairs of points of one page less than ``radius`` apart, with their distance."""
    p = points.select(id_column, on, F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    pairs = overlap_pairs(p, p, radius, radius, on).where(F.col(f"a_{id_column}") < F.col(f"b_{id_column}"))
    gap = G.distance(F.col("a_x0"), F.col("a_y0"), F.col("b_x0"), F.col("b_y0"))
    return pairs.select(F.col(f"a_{id_column}").alias("a"), F.col(f"b_{id_column}").alias("b"), gap.alias("distance")).where(F.col("distance") < radius)


def nearest_neighbours(points: DataFrame, k: int, radius: float, id_column: str, on: str = "page") -> DataFrame:
    """Undirected edges from each point to its ``k`` nearest within ``radius``; ties to the smaller id."""
    near = radius_pairs(points, radius, id_column, on)
    both = near.union(near.select("b", "a", "distance"))
    ranked = both.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))).where(F.col("n") <= k)
    return ranked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance").distinct()


def nearest(places: DataFrame, targets: DataFrame, on: str = "page") -> DataFrame:
    """(page, x, y, id, distance): of ``targets`` (page, id, x, y) the nearest to each of ``places`` (page, x, y), at any distance.

    On a page with at most ``LEAF`` places of targets each place is held against all of them.  Else the page's square is
    halved level by level: a cell that holds targets stays for a place if its near side is no further than the far side
    of every other cell; each level is one equi-join, and a place keeps a few cells, wherever targets
    crowd.  Ties fall to the smaller id; places on a page without targets have no row.
    """
    spots = targets.groupBy(on, F.col("x").alias("tx"), F.col("y").alias("ty")).agg(F.min("id").alias("id"))
    side = F.greatest(F.max("tx") - F.min("tx"), F.max("ty") - F.min("ty"), F.lit(1e-9))
    frame = spots.groupBy(on).agg(F.count("*").alias("spots"), F.min("tx").alias("left"), F.min("ty").alias("top"), side.alias("side"))
    spots = checkpointed(spots.join(frame, on))
    asked = places.select(on, "x", "y").distinct()
    leaf = spots.where(F.col("spots") <= LEAF).groupBy(on).agg(_held())
    best = _nearest_held(asked.join(leaf, on), on).select(on, "x", "y", "best.id", "best.distance")
    crowded = spots.where(F.col("spots") > LEAF)
    if crowded.isEmpty():
        return best
    return best.unionByName(_nearest_by_cells(crowded, checkpointed(asked.join(frame.where(F.col("spots") > LEAF), on)), on))


def _held() -> Column:
    """An aggregate: a group's targets in one row, by id, so that no row is made for each pair."""
    return F.array_sort(F.collect_list(F.struct("id", "tx", "ty"))).alias("held")


def _nearest_held(asked: DataFrame, on: str) -> DataFrame:
    """(page, x, y, best): of the targets held in its row the one nearest to each place."""
    gaps = F.transform("held", lambda s: G.distance(F.col("x"), F.col("y"), s["tx"], s["ty"]))
    out = asked.select(on, "x", "y", "held", gaps.alias("gaps")).withColumn("distance", F.array_min("gaps"))
    first = F.get("held", F.array_position("gaps", F.col("distance")).cast("int") - 1)  # the least id of equals
    return out.select(on, "x", "y", F.struct("distance", first["id"].alias("id")).alias("best"))


def _nearest_by_cells(spots: DataFrame, asked: DataFrame, on: str) -> DataFrame:
    """``nearest`` for pages with many targets; both tables are computed once before, and have the page's frame."""
    at = lambda c, low, parts: F.least(F.floor((F.col(c) - F.col(low)) / F.col("side") * parts), F.lit(parts) - 1).cast("long")
    levels: list[DataFrame] = []
    while len(levels) < DEEPEST:  # levels are counted only as deep as the fullest cell asks for
        parts = float(2 << len(levels))
        cells = spread(spots, on, "tx", "ty", rows=MANY).groupBy(on, at("tx", "left", parts).alias("ix"), at("ty", "top", parts).alias("iy")).agg(F.count("*").alias("n"))
        levels.append(checkpointed(cells))
        if levels[-1].agg(F.max("n")).first()[0] <= LEAF:
            break
    depth = len(levels)

    halves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    put = lambda df, ix, iy: df.withColumn("h", F.explode(halves)).withColumn("ix", ix).withColumn("iy", iy).drop("h")
    tried = put(spread(asked, on, "x", "y", rows=MANY), F.col("h.a").cast("long"), F.col("h.b").cast("long"))
    mine = Window.partitionBy(on, "x", "y")
    for level in range(1, depth + 1):
        if level > 1:
            tried = put(tried, 2 * F.col("ix") + F.col("h.a"), 2 * F.col("iy") + F.col("h.b"))
        size = F.col("side") / float(1 << level)
        a, b = F.col("left") + F.col("ix") * size, F.col("top") + F.col("iy") * size
        near = G.rect_distance(F.col("x"), F.col("y"), a, b, a + size, b + size)
        far = G.distance(F.lit(0.0), F.lit(0.0), F.greatest(F.col("x") - a, a + size - F.col("x")), F.greatest(F.col("y") - b, b + size - F.col("y")))
        held = levels[level - 1].select(on, "ix", "iy")
        tried = tried.join(held, [on, "ix", "iy"]).withColumn("near", near).withColumn("bound", F.min(far).over(mine))
        # the slack covers rounded cell edges
        tried = tried.where(F.col("near") <= F.col("bound") + 1e-6 * F.col("side")).drop("near", "bound")
    leaf = spots.groupBy(on, at("tx", "left", float(1 << depth)).alias("ix"), at("ty", "top", float(1 << depth)).alias("iy")).agg(_held())
    best = _nearest_held(tried.select(on, "x", "y", "ix", "iy").join(leaf, [on, "ix", "iy"]), on)
    best = best.groupBy(on, "x", "y").agg(F.min("best").alias("best"))
    return best.select(on, "x", "y", "best.id", "best.distance")


def within(boxes: DataFrame, window: DataFrame, cell: float, on: str = "page") -> DataFrame:
    """The boxes that meet any of the windows; a short list is sent to the boxes instead of both being dealt out."""
    out = overlap_pairs(boxes, window, cell, 0.0, on)
    return out.select([F.col(f"a_{c}").alias(c) for c in boxes.columns]).distinct()


def items_near(items: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Filter, then refine: segments (page, item_id, ax, ay, bx, by) whose distance to a point is at most ``radius``."""
    seg = items.withColumn("x0", F.least("ax", "bx")).withColumn("y0", F.least("ay", "by")).withColumn("x1", F.greatest("ax", "bx")).withColumn("y1", F.greatest("ay", "by"))
    p = points.select("point_id", "page", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    pairs = overlap_pairs(seg, p, 4 * radius, 2 * radius)
    d = G.segment_distance(F.col("b_x0"), F.col("b_y0"), F.col("a_ax"), F.col("a_ay"), F.col("a_bx"), F.col("a_by"))
    return pairs.select(F.col("b_point_id").alias("point_id"), F.col("a_item_id").alias("item_id"), d.alias("distance")).where(F.col("distance") <= radius)


def snapped(points: DataFrame, pixels: DataFrame, radius: int) -> DataFrame:
    """The nearest set pixel in a square around each point, ties by row, then column; else the point's own place."""
    box = points.select("point_id", "page", (F.col("x") - radius).alias("x0"), (F.col("y") - radius).alias("y0"), (F.col("x") + radius).alias("x1"), (F.col("y") + radius).alias("y1"), "x", "y")
    px = pixels.select("page", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    pairs = overlap_pairs(box, px, 2.0 * radius + 1)
    square = (F.col("a_x") - F.col("b_x0")) ** 2 + (F.col("a_y") - F.col("b_y0")) ** 2
    best = pairs.groupBy(F.col("a_point_id").alias("point_id")).agg(F.min(F.struct(square.alias("d"), F.col("b_y0").alias("y"), F.col("b_x0").alias("x"))).alias("best"))
    return points.join(best, "point_id", "left").select("point_id", "page", F.coalesce("best.x", "x").alias("x"), F.coalesce("best.y", "y").alias("y"), F.col("best").isNotNull().alias("snapped"))


def closest_row(points: DataFrame, x: float, y: float, id_column: str) -> Column:
    """An aggregate: the id of the point nearest to an anchor."""
    return F.min(F.struct(G.distance(F.col("x"), F.col("y"), F.lit(x), F.lit(y)).alias("distance"), F.col(id_column))).alias("nearest")
