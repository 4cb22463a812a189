"""Legends, scale bars, search windows and predicates on drawings and words.

Words have (page, word_no, x0, y0, x1, y1, text); lines (page, line_no, text, x0..y1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.functions import geometry as G


def scale_candidates(lines: DataFrame) -> DataFrame:
    """Lines that may state a scale: the word, a ratio, or nts."""
    return lines.where(F.lower("text").rlike(r"scale|\b\d+\s*:\s*\d+\b|\bnts\b"))


def inside(df: DataFrame, region: tuple[float, float, float, float]) -> DataFrame:
    """Boxes with all four edges in a region."""
    a, b, c, d = region
    return df.where((F.col("x0") >= a) & (F.col("y0") >= b) & (F.col("x1") <= c) & (F.col("y1") <= d))


def touching(df: DataFrame, region: tuple[float, float, float, float]) -> DataFrame:
    a, b, c, d = region
    return df.where((F.col("x1") >= a) & (F.col("x0") <= c) & (F.col("y1") >= b) & (F.col("y0") <= d))


def color_match(drawings: DataFrame, color: list[float], threshold: float, strokes: bool = False) -> DataFrame:
    """Drawings near a colour, by fill first and, if asked for, by stroke; adds channel and match_distance."""
    target = F.array(*[F.lit(c) for c in color])
    fill, stroke = G.rgb_distance(F.col("fill"), target), G.rgb_distance(F.col("stroke"), target)
    by_fill, by_stroke = F.coalesce(fill <= threshold, F.lit(False)), F.coalesce(stroke <= threshold, F.lit(False)) & F.lit(strokes)
    channel = F.when(by_fill, "fill").when(by_stroke, "stroke")
    return drawings.withColumn("channel", channel).where("channel is not null").withColumn("match_distance", F.when(F.col("channel") == "fill", fill).otherwise(stroke))


def bar_rectangles(drawings: DataFrame, region: tuple[float, float, float, float]) -> DataFrame:
    """Flat bars that touch a region, one of each rounded box, ordered by (y, x)."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    flat = touching(drawings, region).where((w >= 5) & (h >= 1) & (w / F.greatest(h, F.lit(0.1)) >= 2))
    keys = [F.round(c, 1) for c in ("x0", "y0", "x1", "y1")]
    n = F.row_number().over(Window.partitionBy("page", *keys).orderBy("drawing_id"))
    return flat.withColumn("n", n).where("n = 1").drop("n").orderBy("page", "y0", "x0")


def under_area_share(drawings: DataFrame, page_area: float, most: float) -> DataFrame:
    """By page: boxes within a share of the page's area, and those over it."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return drawings.groupBy("page").agg(F.count_if(area <= most * page_area).alias("kept"), F.count_if(area > most * page_area).alias("skipped"))


def dark_dashes(drawings: DataFrame, low: float = 5.0, high: float = 100.0) -> DataFrame:
    """Small black filled boxes."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return drawings.where((total(F.col("fill")) == 0) & (area > low) & (area < high))


def dashed(drawings: DataFrame) -> DataFrame:
    return drawings.where("dashes is not null and dashes <> '[] 0'")


def total(color: Column) -> Column:
    """The sum of a colour's channels; null without a colour."""
    return F.aggregate(color, F.lit(0.0), lambda s, c: s + c)


def is_black(color: Column) -> Column:
    return F.coalesce(total(color) < 0.1, F.lit(False))


def legend_region(lines: DataFrame, pages: DataFrame, pad: float = 12.0) -> DataFrame:
    """(page, x0, y0, x1, y1): around the first line that says legend, else the page's lower right.

    ``pages`` holds (page, width, height); regions are padded and kept on the page.
    """
    first = lines.where(F.lower("text").rlike(r"\blegend\b")).groupBy("page").agg(F.min(F.struct("line_no", "x0", "y0", "x1", "y1")).alias("l"))
    p = pages.join(first, "page", "left")
    edge = lambda c, sign, share, most: F.when(F.col("l").isNotNull(), F.greatest(F.col(f"l.{c}") + sign * pad, F.lit(0.0))).otherwise(share * F.col(most))
    return p.select(
        "page", edge("x0", -1, 0.60, "width").alias("x0"), edge("y0", -1, 0.55, "height").alias("y0"),
        F.least(edge("x1", 1, 0.98, "width"), F.col("width")).alias("x1"), F.least(edge("y1", 1, 0.98, "height"), F.col("height")).alias("y1"),
    )


def legend_entries(lines: DataFrame, regions: DataFrame, words=G.FEATURE_WORDS) -> DataFrame:
    """Lines in their page's legend region that name a feature."""
    r = regions.select("page", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    met = lines.join(r, "page").where("x1 >= r_x0 and x0 <= r_x1 and y1 >= r_y0 and y0 <= r_y1")
    return met.withColumn("feature_type", G.feature_type(F.col("text"), words)).where("feature_type is not null").drop("r_x0", "r_y0", "r_x1", "r_y1")


def envelope(boxes: DataFrame, key: str, pad: float = 0.0) -> DataFrame:
    return boxes.groupBy(key).agg((F.min("x0") - pad).alias("x0"), (F.min("y0") - pad).alias("y0"), (F.max("x1") + pad).alias("x1"), (F.max("y1") + pad).alias("y1"))


def _banded(df: DataFrame, y: str, width: float, reach: int) -> DataFrame:
    """Rows by bands of height, and with ``reach`` 1 also by those next to their own: what is at most ``width`` apart shares one."""
    wide = width * (1 + 1e-9) if width > 0 else 1.0  # a rounded quotient must not skip a band
    return df.withColumn("band", F.explode(F.array(*[F.floor(F.col(y) / wide) + k for k in range(-reach, reach + 1)])))


def token_pairs(words: DataFrame, left: str, right: str, band: float = 5.0) -> DataFrame:
    """The nearest word ``right`` to the right of each word ``left``, in a band of heights."""
    a = words.where(F.lower("text") == left).select("page", F.col("word_no").alias("left_no"), F.col("x1").alias("ax"), F.col("y0").alias("ay"))
    b = words.where(F.lower("text") == right).select("page", F.col("word_no").alias("right_no"), F.col("x0").alias("bx"), F.col("y0").alias("b_y"))
    a, b = _banded(a, "ay", band, 1), _banded(b, "b_y", band, 0)
    near = a.join(b, ["page", "band"]).where((F.abs(F.col("ay") - F.col("b_y")) <= band) & (F.col("bx") >= F.col("ax")))
    return near.groupBy("page", "left_no").agg(F.min(F.struct((F.col("bx") - F.col("ax")).alias("gap"), "right_no")).alias("best")).select("page", "left_no", "best.right_no", "best.gap")


def ticks_right_of(words: DataFrame, labels: DataFrame, band: float = 40.0) -> DataFrame:
    """Numbers in a band right of a label (page, x, y), as ticks (page, value, x); of equal ones the first."""
    n = words.where(F.col("text").rlike(r"^\d+(?:\.\d+)?$")).select("page", "word_no", F.col("text").cast("double").alias("value"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), F.col("y0").alias("wy"))
    n, own = _banded(n, "wy", band, 0), _banded(labels.select("page", F.col("x").alias("lx"), F.col("y").alias("ly")), "ly", band, 1)
    met = n.join(own, ["page", "band"]).where((F.col("cx") >= F.col("lx")) & (F.abs(F.col("wy") - F.col("ly")) <= band))
    return met.groupBy("page", "value").agg(F.min(F.struct("word_no", "cx")).alias("f")).select("page", "value", F.col("f.cx").alias("x"))


def text_centre(words: DataFrame, term: str) -> DataFrame:
    """By page: the centre of the last word that contains the term."""
    hit = words.where(F.lower("text").contains(term.lower()))
    return hit.groupBy("page").agg(F.max_by(F.struct(((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y")), "word_no").alias("c")).select("page", "c.x", "c.y")


def text_markers(words: DataFrame, pages: DataFrame, term: str) -> DataFrame:
    """(page, word_no, ny, nx): the centres of all words that contain the term, on a grid of 1000 by 1000 of their page (page, width, height)."""
    hit = words.where(F.lower("text").contains(term.lower())).join(pages.select("page", "width", "height"), "page")
    put = lambda c, most: F.bround((F.col(f"{c}0") + F.col(f"{c}1")) / 2 / F.col(most) * 1000, 2).alias(f"n{c}")
    return hit.select("page", "word_no", put("y", "height"), put("x", "width"))


def legend_window(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, x0, y0, x1, y1): 20 above and left and 260 below and right of the first line that says legend, kept on the page; else the page's upper left part."""
    first = lines.where(F.lower("text").rlike(r"\blegend\b")).groupBy("page").agg(F.min(F.struct("line_no", "x0", "y0", "x1", "y1")).alias("l"))
    p = pages.join(first, "page", "left")
    low = lambda c, share, most: F.when(F.col("l").isNotNull(), F.greatest(F.col(f"l.{c}") - 20.0, F.lit(0.0))).otherwise(share * F.col(most)).alias(c)
    high = lambda c, share, most: F.when(F.col("l").isNotNull(), F.least(F.col(f"l.{c}") + 260.0, F.col(most))).otherwise(share * F.col(most)).alias(c)
    return p.select("page", low("x0", 0.05, "width"), low("y0", 0.05, "height"), high("x1", 0.45, "width"), high("y1", 0.55, "height"))


def media_type(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.endswith(".pdf"), "application/pdf").when(low.endswith(".png"), "image/png").when(low.endswith(".jpg") | low.endswith(".jpeg"), "image/jpeg").otherwise("application/octet-stream")


def confirmation(actions: Column, confirmed: Column) -> Column:
    """What was confirmed and what was not, in words."""
    part = lambda name, a: F.when(F.size(a) > 0, F.concat(F.lit(name + ": "), F.array_join(a, ", ")))
    return F.concat_ws("; ", part("Confirmed", F.array_intersect(actions, confirmed)), part("Not confirmed", F.array_except(actions, confirmed)))


def rooted(path: Column) -> Column:
    """Forward slashes, with one in front."""
    path = F.regexp_replace(path, r"\\", "/")
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def target_color(entries: DataFrame, label: str) -> DataFrame:
    """(label, color) of the first ``ok`` entry (label, status, color, entry_no) of that label, however written; an error if there is none."""
    fit = entries.where((G.normal_label(F.col("label")) == label.strip().upper()) & (F.col("status") == "ok") & F.col("color").isNotNull())
    first = fit.agg(F.min_by(F.struct("label", "color"), "entry_no").alias("e"))
    missing = F.raise_error(F.lit(f"no colour for label {label}"))
    return first.select(F.coalesce(F.col("e.label"), missing.cast("string")).alias("label"), F.col("e.color").alias("color"))


def exclusion_rects(boxes: DataFrame, regions: DataFrame, scale: float, pad: int, width: int, height: int) -> DataFrame:
    """(page, x0, y0, x1, y1) in pixels around a page's labels and swatches, else its legend region; padded, on the image."""
    around = envelope(boxes, "page").select("page", F.struct("x0", "y0", "x1", "y1").alias("own"))
    both = regions.join(around, "page", "left")
    edge = lambda c: G.to_pixel(F.coalesce(F.col(f"own.{c}"), F.col(c)), scale)
    low = lambda c: F.greatest(F.lit(0), edge(c) - pad)
    return both.select("page", low("x0").alias("x0"), low("y0").alias("y0"), F.least(F.lit(width), edge("x1") + pad).alias("x1"), F.least(F.lit(height), edge("y1") + pad).alias("y1"))


def best_pair(words: DataFrame, left: str = "a3", right: str = "scale", band: float = 5.0) -> DataFrame:
    """By page the two words, one height and least apart from left edge to left edge, the second not before the first.

    (page, left_no, right_no, x0, y0, x1, y1, anchor_y, ratio_x1): with the box around both.
    """
    box = ("x0", "y0", "x1", "y1")
    a = words.where(F.lower("text") == left).select("page", F.col("word_no").alias("left_no"), *[F.col(c).alias(f"a{c}") for c in box])
    b = words.where(F.lower("text") == right).select("page", F.col("word_no").alias("right_no"), *[F.col(c).alias(f"b{c}") for c in box])
    met = _banded(a, "ay0", band, 1).join(_banded(b, "by0", band, 0), ["page", "band"])
    met = met.where((F.abs(F.col("ay0") - F.col("by0")) <= band) & (F.col("bx0") >= F.col("ax0")))
    best = met.groupBy("page").agg(F.min(F.struct((F.col("bx0") - F.col("ax0")).alias("gap"), "left_no", "right_no", *[f"{p}{c}" for p in "ab" for c in box])).alias("m")).select("page", "m.*")
    edges = [(F.least if c.endswith("0") else F.greatest)(f"a{c}", f"b{c}").alias(c) for c in box]
    return best.select("page", "left_no", "right_no", *edges, ((F.col("ay0") + F.col("by0")) / 2).alias("anchor_y"), F.col("bx1").alias("ratio_x1"))


def ratio_values(pairs: DataFrame, words: DataFrame, band: float = 8.0, reach: float = 40.0) -> DataFrame:
    """(page, ratio_no, ratio): the whole number that starts nearest to the right of a pair, at most ``reach`` away and in a band of heights."""
    n = words.where(F.col("text").rlike(r"^\d{2,5}$")).select("page", "word_no", "text", F.col("x0").alias("nx"), F.col("y0").alias("ny"))
    met = n.join(pairs.select("page", "anchor_y", "ratio_x1"), "page")  # one pair a page
    gap = F.col("nx") - F.col("ratio_x1")
    met = met.where((F.abs(F.col("ny") - F.col("anchor_y")) <= band) & (gap >= 0) & (gap <= reach))
    best = met.groupBy("page").agg(F.min(F.struct(gap.alias("gap"), "word_no", "text")).alias("b"))
    return best.select("page", F.col("b.word_no").alias("ratio_no"), F.col("b.text").cast("int").alias("ratio"))


def search_boxes(labels: DataFrame, ticks: DataFrame) -> DataFrame:
    """(page, x0, y0, x1, y1): where the bar is looked for, around a label's box and its ticks', with room below; without ticks right of the label."""
    t = ticks.select("page", F.struct("x0", "y0", "x1", "y1").alias("t"))
    both = labels.join(t, "page", "left")
    some = F.col("t").isNotNull()
    low = lambda c, off: F.greatest(F.lit(0.0), F.least(F.col(c), F.col(f"t.{c}")) - off)
    high = lambda c, off: F.greatest(F.col(c), F.col(f"t.{c}")) + off
    return both.select(
        "page", F.when(some, low("x0", 2.0)).otherwise(F.col("x1") + 4.0).alias("x0"), F.when(some, low("y0", 6.0)).otherwise(F.col("y0") - 6.0).alias("y0"),
        F.when(some, high("x1", 2.0)).otherwise(F.col("x1") + 220.0).alias("x1"), F.when(some, high("y1", 14.0)).otherwise(F.col("y1") + 14.0).alias("y1"),
    )


def checked_calibration(calibration: DataFrame, ratios: DataFrame, dpi: float) -> DataFrame:
    """Adds to a calibration by page the metres a pixel that its stated ratio gives; null without one."""
    out = calibration.join(ratios.select("page", "ratio"), "page", "left")
    return out.withColumn("ratio_m_per_px", F.round(25.4 / F.lit(float(dpi)) * F.col("ratio") / 1000.0, 9))


def metres_per_pixel(m_per_pt: Column, width_px: Column, height_px: Column, width_pt: Column, height_pt: Column) -> Column:
    """The mean of both axes, from the size of an image of a page."""
    return 0.5 * (m_per_pt / (width_px / width_pt) + m_per_pt / (height_px / height_pt))


def metres_by_density(m_per_pt: Column, pixels_per_pt: Column) -> Column:
    return m_per_pt / pixels_per_pt


def number(value: Column) -> Column:
    """A number, or null where the value does not read as one."""
    return value.try_cast("double")


def numbers(values: Column, count: int) -> Column:
    """The first ``count`` members as numbers, rounded to six places; null if one is missing or none."""
    made = F.transform(F.slice(values, 1, count), lambda v: F.round(v.try_cast("double"), 6))
    return F.when((F.size(values) >= count) & ~F.exists(made, lambda v: v.isNull()), made)


def thick(width: Column, least: float = 2.0) -> Column:
    return F.coalesce(width > least, F.lit(False))
