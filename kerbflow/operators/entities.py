"""Entity extraction: keyword hits, links from labels to geometry, legends, colours, scale.

Drawings have (drawing_id, page, x0, y0, x1, y1) and may have ``fill`` and ``stroke``
arrays; text hits have (hit_id, page, text, x, y) with the centre of their box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.functions import geometry as G
from kerbflow.operators import spatial

#: Links below this score are reviewed by hand.
REVIEW_SCORE = 0.45


def keyword_hits(tokens: DataFrame, patterns=G.KEYWORD_PATTERNS, text: str = "text") -> DataFrame:
    """One row for each pattern that a row's text matches; patterns are few and fixed."""
    listed = F.array(*[F.when(F.col(text).rlike(p), F.lit(name)) for name, p in patterns])
    return tokens.withColumn("keyword", F.explode(F.array_compact(listed)))


def fallback_hits(lines: DataFrame, patterns=G.KEYWORD_PATTERNS, text: str = "text") -> DataFrame:
    """Lines that match any pattern, as hits without coordinates (-1)."""
    every = "|".join(f"(?:{p.removeprefix('(?i)')})" for _, p in patterns)
    return lines.where(F.lower(F.col(text)).rlike(every)).withColumn("x", F.lit(-1.0)).withColumn("y", F.lit(-1.0))


def nearest_drawing(hits: DataFrame, drawings: DataFrame) -> DataFrame:
    """Each hit with the drawing of its page whose centre is nearest, or unlinked.

    Ties fall to the smaller drawing_id.  Hits without coordinates stay unlinked.  The search is
    made once for each place, however many hits it has.
    """
    centre = drawings.select("page", F.col("drawing_id").alias("id"), G.midpoint(F.col("x0"), F.col("x1")).alias("x"), G.midpoint(F.col("y0"), F.col("y1")).alias("y"))
    near = spatial.nearest(hits.where("x >= 0 and y >= 0"), centre)
    near = near.select("page", "x", "y", F.struct("distance", F.col("id").alias("drawing_id")).alias("best"))
    out = hits.join(near, ["page", "x", "y"], "left")
    return out.select(
        *hits.columns, F.col("best.drawing_id").alias("linked_drawing_id"), F.col("best.distance").alias("distance"),
        F.coalesce(G.link_score(F.col("best.distance")), F.lit(0.0)).alias("score"), F.when(F.col("best").isNull(), "unlinked").otherwise("linked").alias("link_status"),
    )


def feature_summary(links: DataFrame) -> DataFrame:
    """Counts, mean score and length by feature type."""
    linked = F.col("link_status") == "linked"
    return links.groupBy("feature_type").agg(
        F.count("*").alias("hit_count"), F.count_if(linked).alias("linked_count"),
        F.round(F.coalesce(F.avg(F.when(linked, F.col("score"))), F.lit(0.0)), 4).alias("avg_score"),
        F.round(F.coalesce(F.sum(F.when(linked, F.col("length"))), F.lit(0.0)), 4).alias("total_length"),
    )


def review_queue(links: DataFrame, least: float = REVIEW_SCORE) -> DataFrame:
    return links.where((F.col("link_status") == "unlinked") | (F.col("score") < least))


def path_length_proxy(items: Column) -> Column:
    """Lines count their length, boxes their outline, curves nothing."""
    line = lambda i: F.sqrt((i["p1"][0] - i["p0"][0]) ** 2 + (i["p1"][1] - i["p0"][1]) ** 2)
    box = lambda i: 2 * (F.abs(i["rect"][2] - i["rect"][0]) + F.abs(i["rect"][3] - i["rect"][1]))
    return F.aggregate(items, F.lit(0.0), lambda s, i: s + F.when(i["op"] == "l", line(i)).when(i["op"] == "re", box(i)).otherwise(0.0))


def match_swatches(labels: DataFrame, swatches: DataFrame, reach: float = 140.0, overlap: float = 0.4) -> DataFrame:
    """The best swatch left of each legend label, or none.

    A swatch fits if it ends at most ``reach`` before the label and shares enough height;
    the score is the gap and half the difference of the middles.  Ties fall to the smaller
    swatch_id.
    """
    strip = labels.select("page", "label_id", (F.col("x0") - reach).alias("x0"), "y0", F.col("x0").alias("x1"), "y1")
    edges = swatches.select("page", "swatch_id", F.col("x1").alias("x0"), "y0", "x1", "y1")  # a swatch's right edge
    met = spatial.overlap_pairs(strip, edges, reach)
    gap = F.col("a_x1") - F.col("b_x1")
    fits = (gap >= 0) & (gap <= reach) & (G.y_overlap_ratio(F.col("a_y0"), F.col("a_y1"), F.col("b_y0"), F.col("b_y1")) >= overlap)
    score = gap + 0.5 * F.abs(G.midpoint(F.col("b_y0"), F.col("b_y1")) - G.midpoint(F.col("a_y0"), F.col("a_y1")))
    best = met.where(fits).groupBy(F.col("a_label_id").alias("label_id")).agg(F.min(F.struct(score.alias("score"), F.col("b_swatch_id").alias("swatch_id"))).alias("best"))
    out = labels.select("label_id", "page").join(best, "label_id", "left")
    return out.select("label_id", "page", F.col("best.swatch_id").alias("swatch_id"), F.col("best.score").alias("match_score"), F.when(F.col("best").isNull(), "no_swatch_found").otherwise("ok").alias("status"))


def first_of(df: DataFrame, keys: list, order: list[str]) -> DataFrame:
    """The first row of each key; earlier rows win, as in a scan with a set of seen keys."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def dedupe_rects(drawings: DataFrame, digits: int = 1) -> DataFrame:
    """The first drawing of each rounded box and fill."""
    return first_of(drawings, [*(F.round(c, digits) for c in ("x0", "y0", "x1", "y1")), F.col("fill")], ["drawing_id"])


#: Target colours up to which drawings are streamed past all of them.
COLORS = 10_000


def color_hits(colors: DataFrame, drawings: DataFrame, threshold: float) -> DataFrame:
    """By target colour: drawings whose fill, whose stroke, or either is near.

    Drawings are streamed past a short list of colours (a legend); a list of more than
    ``COLORS``, which are counted, is joined by cells of colour as wide as the threshold.
    """
    near = lambda c: F.coalesce(G.rgb_distance(F.col("color"), F.col(c)) <= threshold, F.lit(False))
    if colors.count() <= COLORS:
        pairs = drawings.select("fill", "stroke").crossJoin(F.broadcast(colors))
        pairs = pairs.select("color_id", near("fill").alias("f"), near("stroke").alias("s"))
        return pairs.groupBy("color_id").agg(F.count_if("f").alias("fill_hits"), F.count_if("s").alias("stroke_hits"), F.count_if(F.col("f") | F.col("s")).alias("matched"))

    width = threshold * (1 + 1e-9) if threshold > 0 else 1.0  # a rounded quotient must not skip a cell
    cell = lambda c, k: F.floor(F.col(c)[k] / width)
    around = [F.explode(F.array(*[cell("color", k) + d for d in (-1, 0, 1)])).alias(f"cell{k}") for k in range(3)]
    spread = colors.select("color_id", "color")
    for k in range(3):
        spread = spread.select("*", around[k])
    kinds = drawings.groupBy("fill", "stroke").agg(F.count("*").alias("n"))
    at = lambda c: kinds.select("*", *[cell(c, k).alias(f"cell{k}") for k in range(3)]).join(spread, ["cell0", "cell1", "cell2"]).where(near(c))
    none = F.lit(0).cast("long")
    hits = at("fill").select("color_id", F.col("n").alias("f"), none.alias("s"), F.when(near("stroke"), F.col("n")).otherwise(none).alias("both"))
    hits = hits.unionByName(at("stroke").select("color_id", none.alias("f"), F.col("n").alias("s"), none.alias("both")))
    # colours without a hit count 0 unless there are no drawings
    rest = colors.select("color_id").crossJoin(F.broadcast(drawings.select(F.lit(1)).limit(1))).select("color_id", none.alias("f"), none.alias("s"), none.alias("both"))
    sums = hits.unionByName(rest).groupBy("color_id").agg(F.sum("f").alias("fill_hits"), F.sum("s").alias("stroke_hits"), F.sum("both").alias("both"))
    return sums.select("color_id", "fill_hits", "stroke_hits", (F.col("fill_hits") + F.col("stroke_hits") - F.col("both")).alias("matched"))


def geometry_gate(drawings: DataFrame, area: float, short: float, long: float) -> DataFrame:
    w, h = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    return drawings.where((w * h >= area) & (F.least(w, h) >= short) & (F.greatest(w, h) >= long))


def overlay_candidates(drawings: DataFrame, thin: float) -> DataFrame:
    """Thin drawings with a green, blue or dark fill."""
    r, g, b = (F.col("fill")[k] for k in range(3))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    green, blue, dark = (g > r) & (g > b), (b > r) & (b > g), (r < 0.3) & (g < 0.3) & (b < 0.3)
    kind = F.when(green, "green").when(blue, "blue").when(dark, "dark")
    return drawings.where(F.least(w, h) <= thin).withColumn("overlay", kind).where("overlay is not null")


def drawn_after(drawings: DataFrame, candidates: DataFrame, order: str = "drawing_id") -> DataFrame:
    """Drawings that come after the first candidate in drawing order."""
    first = candidates.agg(F.min(order).alias("__first"))  # one row
    return drawings.crossJoin(F.broadcast(first)).where(F.col(order) > F.col("__first")).drop("__first")


def style_semi_join(drawings: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """All drawings in a style of the chosen ones; a null colour counts as black."""
    return drawings.join(chosen.select(*keys).distinct(), keys, "left_semi")


def calibration(ticks: DataFrame, dpi: float) -> DataFrame:
    """Metres a point and a pixel from the tick marks of scale bars, by page.

    The ticks 0 and 25 are taken where both exist, else the least and the greatest value.
    """
    by = ticks.groupBy("page").agg(
        F.min(F.when(F.col("value") == 0, F.col("x"))).alias("x_0"), F.min(F.when(F.col("value") == 25, F.col("x"))).alias("x_25"),
        F.min(F.struct("value", "x")).alias("low"), F.max(F.struct("value", "x")).alias("high"),
    )
    named = F.col("x_0").isNotNull() & F.col("x_25").isNotNull()
    metres = F.when(named, F.lit(25.0)).otherwise(F.col("high.value") - F.col("low.value"))
    points = F.abs(F.when(named, F.col("x_25") - F.col("x_0")).otherwise(F.col("high.x") - F.col("low.x")))
    out = by.select("page", metres.cast("double").alias("delta_m"), points.alias("delta_pt")).where("delta_m > 0 and delta_pt > 0")
    return out.withColumn("m_per_pt", F.round(F.col("delta_m") / F.col("delta_pt"), 9)).withColumn("m_per_px", F.round(F.col("delta_m") / F.col("delta_pt") / (dpi / 72.0), 9))
