"""Path items of drawings: chains, distances to points, whole drawings, pixel boxes, visibility.

Items have (page, drawing_id, item_no, op, ax, ay, bx, by) and, for curves, the control points
(c1x, c1y, c2x, c2y).  ``op`` is ``l`` for a line, ``c`` for a cubic curve, ``re`` for a box
whose corners are a and b.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.functions import geometry as G
from kerbflow.operators import shapes, spatial

#: Samples of a curve, one more than its parts.
SAMPLES = 101


def _on_curve(t: Column) -> tuple[Column, Column]:
    return tuple(G.bezier(F.col(f"a{c}"), F.col(f"c1{c}"), F.col(f"c2{c}"), F.col(f"b{c}"), t) for c in "xy")


def chained(items: DataFrame, curve_steps: int = 24, key: str = "drawing_id") -> DataFrame:
    """(key, i, x, y): the lines and curves of each drawing as one polyline, in the order of its items.

    An item's first point is left out where it lies within 1e-6 of the last point before it.
    Boxes, and items with a missing coordinate, are passed over.
    """
    steps = max(2, curve_steps)
    need = {"l": ("ax", "ay", "bx", "by"), "c": ("ax", "ay", "bx", "by", "c1x", "c1y", "c2x", "c2y")}
    whole = {op: F.col("op") == op for op in need}
    for op, columns in need.items():
        for c in columns:
            whole[op] = whole[op] & F.col(c).isNotNull()
    w = Window.partitionBy(key).orderBy("item_no")
    df = items.where(whole["l"] | whole["c"]).withColumn("px", F.lag("bx").over(w)).withColumn("py", F.lag("by").over(w))
    joint = F.coalesce(G.distance(F.col("px"), F.col("py"), F.col("ax"), F.col("ay")) <= 1e-6, F.lit(False))
    last = F.when(F.col("op") == "c", steps).otherwise(1)
    df = df.withColumn("k", F.explode(F.sequence(F.when(joint, 1).otherwise(0), last))).withColumn("t", F.col("k") / last)
    x, y = _on_curve(F.col("t"))
    line = lambda c: F.when(F.col("k") == 0, F.col(f"a{c}")).otherwise(F.col(f"b{c}"))
    df = df.select(key, "item_no", "k", F.when(F.col("op") == "c", x).otherwise(line("x")).alias("x"), F.when(F.col("op") == "c", y).otherwise(line("y")).alias("y"))
    return df.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("item_no", "k")) - 1).alias("i"), "x", "y")


def item_distance(px: Column, py: Column, p: str = "") -> Column:
    """From a point to an item; to a curve from ``SAMPLES`` points of it.  ``p`` prefixes the item's columns."""
    c = lambda n: F.col(p + n)
    low = lambda n: F.least(c(f"a{n}"), c(f"b{n}"))
    high = lambda n: F.greatest(c(f"a{n}"), c(f"b{n}"))
    at = lambda n, t: G.bezier(c(f"a{n}"), c(f"c1{n}"), c(f"c2{n}"), c(f"b{n}"), t)
    dots = F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda k: G.distance(px, py, at("x", k / (SAMPLES - 1)), at("y", k / (SAMPLES - 1))))
    line = G.segment_distance(px, py, c("ax"), c("ay"), c("bx"), c("by"))
    return F.when(c("op") == "l", line).when(c("op") == "re", G.rect_distance(px, py, low("x"), low("y"), high("x"), high("y"))).when(c("op") == "c", F.array_min(dots))


def items_within(items: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """(point_id, drawing_id, item_no, distance) of the items at most ``radius`` from points (point_id, page, x, y).

    Boxes around the items, control points included, are joined by cells; what meets is measured.
    """
    edge = lambda f, c: f(F.col(f"a{c}"), F.col(f"b{c}"), F.coalesce(f"c1{c}", f"a{c}"), F.coalesce(f"c2{c}", f"a{c}"))
    boxed = items.withColumns({"x0": edge(F.least, "x"), "y0": edge(F.least, "y"), "x1": edge(F.greatest, "x"), "y1": edge(F.greatest, "y")})
    dots = points.select("point_id", "page", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    met = spatial.overlap_pairs(boxed, dots, 4 * radius, 2 * radius)
    out = met.withColumn("distance", item_distance(F.col("b_x0"), F.col("b_y0"), "a_"))
    return out.where(F.col("distance") <= radius).select(F.col("b_point_id").alias("point_id"), F.col("a_drawing_id").alias("drawing_id"), F.col("a_item_no").alias("item_no"), "distance")


def whole_drawings(items: DataFrame, hits: DataFrame) -> DataFrame:
    """All items of the drawings of which any item is hit."""
    return items.join(hits.select("drawing_id").distinct(), "drawing_id", "left_semi")


def pixel_boxes(drawings: DataFrame, sx: float, sy: float, width: int, height: int) -> DataFrame:
    """Drawings with their boxes in pixels (px0, py0, px1, py1, the ends not included): rounded to even, on the image, in order; empty ones go."""
    put = lambda c, scale, most: G.clamp(G.to_pixel(F.col(c), scale), 0, most)
    xs, ys = (put("x0", sx, width), put("x1", sx, width)), (put("y0", sy, height), put("y1", sy, height))
    out = drawings.withColumns({"px0": F.least(*xs), "py0": F.least(*ys), "px1": F.greatest(*xs), "py1": F.greatest(*ys)})
    return out.where("px1 > px0 and py1 > py0")


def visibility(boxes: DataFrame, pixels: DataFrame, ratio: float = 0.03, least: int = 25) -> DataFrame:
    """Adds to ``pixel_boxes`` the count and share of set pixels (page, y, x) inside, and whether enough show."""
    own = boxes.select("drawing_id", "page", F.col("px0").alias("x0"), F.col("py0").alias("y0"), (F.col("px1") - 1).alias("x1"), (F.col("py1") - 1).alias("y1"))
    dots = pixels.select("page", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1")).distinct()
    seen = spatial.overlap_pairs(own, dots, 64.0).groupBy(F.col("a_drawing_id").alias("drawing_id")).agg(F.count("*").alias("n"))
    area = (F.col("px1") - F.col("px0")) * (F.col("py1") - F.col("py0"))
    out = boxes.join(seen, "drawing_id", "left").withColumn("visible_pixels", F.coalesce("n", F.lit(0)).cast("long")).drop("n").withColumn("visible_ratio", F.col("visible_pixels") / area)
    shown = (F.col("visible_ratio") >= ratio) & (F.col("visible_pixels") >= least)
    return out.withColumn("visibility", F.when(shown, "visible").otherwise("hidden_or_occluded"))


def redaction_rects(drawings: DataFrame, page: int) -> DataFrame:
    """The boxes of one page that have a width and a height; what a redaction would cover."""
    return drawings.where((F.col("page") == page) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))).select("page", "drawing_id", "x0", "y0", "x1", "y1")


def small_with_ops(drawings: DataFrame, most: float = 1000.0) -> DataFrame:
    """Drawings of less than an area, with the list of their items' kinds (``path_items`` as read)."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return drawings.where(area < most).withColumn("ops", F.transform("path_items", lambda i: i["op"]))


def component_ends(pixels: DataFrame, least: int = 8, span: int = 1) -> DataFrame:
    """(page, component, size, rank, ay, ax, by, bx): the two ends along the principal axis of each component, largest first.

    Components under ``least`` pixels or ``span`` pixels wide and high are passed over; of equal
    sizes the one with the smaller label comes first.
    """
    size = pixels.groupBy("page", "component").agg(F.count("*").alias("size"), F.greatest(F.max("y") - F.min("y"), F.max("x") - F.min("x")).alias("s"))
    size = size.where((F.col("size") >= least) & (F.col("s") + 1 >= span))
    ends = shapes.axis_ends(pixels, "component")
    rank = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("size"), "component"))
    return size.join(ends, "component").select("page", "component", "size", rank.alias("rank"), "ay", "ax", F.col("b_y").alias("by"), "bx")


#: Components of a page that are linked, the largest.
LINKED = 8


def closest_later(ends: DataFrame, top: int = LINKED) -> DataFrame:
    """(page, a, b, distance): for each of a page's ``top`` components the nearest one of lower rank, by the least of the four distances of their ends.

    Ties fall to the higher rank.  At most ``top`` rows a page meet each other.
    """
    e = ends.where(F.col("rank") <= top)
    a = e.select("page", *[F.col(c).alias(f"a_{c}") for c in ("component", "rank", "ay", "ax", "by", "bx")])
    b = e.select("page", *[F.col(c).alias(f"b_{c}") for c in ("component", "rank", "ay", "ax", "by", "bx")])
    pair = a.join(b, "page").where("a_rank < b_rank")
    gap = F.least(*[G.distance(F.col(f"a_{p}x"), F.col(f"a_{p}y"), F.col(f"b_{q}x"), F.col(f"b_{q}y")) for p in "ab" for q in "ab"])
    best = pair.groupBy("page", "a_component").agg(F.min(F.struct(gap.alias("distance"), "b_rank", "b_component")).alias("best"))
    return best.select("page", F.col("a_component").alias("a"), F.col("best.b_component").alias("b"), F.col("best.distance").alias("distance"))


def images_near(images: DataFrame, centres: DataFrame, reach: float = 50.0) -> DataFrame:
    """(page, xref, x0, y0, x1, y1) of the embedded images (page, xref, rect) that meet the square around their page's centre (page, x, y)."""
    boxes = images.select("page", "xref", *[F.col("rect")[k].alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))])
    near = centres.select("page", (F.col("x") - reach).alias("x0"), (F.col("y") - reach).alias("y0"), (F.col("x") + reach).alias("x1"), (F.col("y") + reach).alias("y1"))
    return spatial.within(boxes, near, 4 * reach)
