"""Labels and drawings linked by a weighted score, each to one other at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.functions import geometry as G
from kerbflow.operators import spatial
from kerbflow.operators.graph import checkpointed


def weighted_score(distance: Column, style: Column, keyword: Column, weights=(0.5, 0.3, 0.2), reach: float = 100.0) -> Column:
    """Between 0 and 1: closeness, agreement of styles (0 to 1) and strength of the keyword (0 to 1), by their weights; nulls count 0."""
    near = 1 / (1 + distance / reach)
    return sum((w * F.coalesce(c, F.lit(0.0)) for w, c in zip(weights, (near, style, keyword))), F.lit(0.0))


def link_scores(labels: DataFrame, drawings: DataFrame, radius: float, weights=(0.5, 0.3, 0.2), reach: float = 100.0) -> DataFrame:
    """(page, label_id, drawing_id, distance, score) of all labels and drawings of a page within a radius.

    ``labels`` are (page, label_id, x, y, style, keyword), ``drawings`` (page, drawing_id, x0, y0, x1, y1, style); places
    meet by grid cells.  Styles agree if they are equal.
    """
    a = labels.select("page", "label_id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"), "style", "keyword")
    mid = lambda c: (F.col(f"{c}0") + F.col(f"{c}1")) / 2
    b = drawings.select("page", "drawing_id", mid("x").alias("x0"), mid("y").alias("y0"), mid("x").alias("x1"), mid("y").alias("y1"), "style")
    pairs = spatial.overlap_pairs(a, b, 2 * radius, radius)
    d = G.distance(F.col("a_x0"), F.col("a_y0"), F.col("b_x0"), F.col("b_y0"))
    same = F.when(F.col("a_style") == F.col("b_style"), 1.0).otherwise(0.0)
    out = pairs.select(F.col("a_page").alias("page"), F.col("a_label_id").alias("label_id"), F.col("b_drawing_id").alias("drawing_id"), d.alias("distance"), same.alias("same"), F.col("a_keyword").cast("double").alias("keyword"))
    out = out.where(F.col("distance") <= radius)
    return out.select("page", "label_id", "drawing_id", "distance", weighted_score(F.col("distance"), F.col("same"), F.col("keyword"), weights, reach).alias("score"))


def one_to_one(scores: DataFrame, least: float = 0.0) -> DataFrame:
    """The pairs of ``scores`` that remain if the best is taken, all others of its label and drawing are struck out, and so on.

    Of equal scores the smaller label counts, then the smaller drawing.  Each round takes all pairs that are the
    best both of their label and of their drawing, which no other choice can undo, so the result is that
    of the one order while the rounds follow the longest chain of rivals.
    """
    left = checkpointed(scores.where(F.col("score") >= least).select("page", "label_id", "drawing_id", "distance", "score"))
    taken = None
    order = [F.desc("score"), "label_id", "drawing_id"]
    while not left.isEmpty():
        ranked = left.withColumn("of_label", F.row_number().over(Window.partitionBy("page", "label_id").orderBy(*order)))
        ranked = ranked.withColumn("of_drawing", F.row_number().over(Window.partitionBy("page", "drawing_id").orderBy(*order)))
        best = checkpointed(ranked.where("of_label = 1 and of_drawing = 1").drop("of_label", "of_drawing"))
        taken = best if taken is None else taken.unionByName(best)
        left = left.join(best.select("page", "label_id"), ["page", "label_id"], "left_anti").join(best.select("page", "drawing_id"), ["page", "drawing_id"], "left_anti")
        left = checkpointed(left)
    return left if taken is None else taken


def weighted_links(labels: DataFrame, drawings: DataFrame, radius: float, least: float = 0.0, weights=(0.5, 0.3, 0.2), reach: float = 100.0) -> DataFrame:
    """Each label with the one drawing that it is linked to, if any: (page, label_id, drawing_id, distance, score, link_status)."""
    found = one_to_one(link_scores(labels, drawings, radius, weights, reach), least)
    out = labels.select("page", "label_id").join(found, ["page", "label_id"], "left")
    return out.withColumn("link_status", F.when(F.col("drawing_id").isNull(), "unlinked").otherwise("linked"))
