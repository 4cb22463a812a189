"""Axes, dashes, polygons and bends."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.functions import geometry as G
from kerbflow.operators import curves, graph


def axis_ends(points: DataFrame, key: str) -> DataFrame:
    """The points that lie furthest out along each group's principal axis.

    The axis is the closed form for two dimensions; of equal projections the smaller (y, x) counts.
    """
    m = points.groupBy(key).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("vxy"))
    m = m.select(key, "mx", "my", (F.atan2(2 * F.col("vxy"), F.col("vx") - F.col("vy")) / 2).alias("angle"))
    along = F.round((F.col("x") - F.col("mx")) * F.cos("angle") + (F.col("y") - F.col("my")) * F.sin("angle"), 9)
    p = points.join(m, key).withColumn("t", along)
    ends = p.groupBy(key).agg(F.min(F.struct("t", "y", "x")).alias("a"), F.min(F.struct((-F.col("t")).alias("t"), "y", "x")).alias("b"))
    return ends.select(key, F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("b_y"))


def vertex_means(corners: DataFrame, key: str) -> DataFrame:
    """(key, x0, y0, x1, y1, cx, cy): the box around each polygon's corners (key, x, y) and their mean."""
    return corners.groupBy(key).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def dash_directions(corners: DataFrame, key: str) -> DataFrame:
    """The direction, 0 to 180 degrees, between the two points of each dash that are furthest apart."""
    a, b = corners.select(key, F.col("i").alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay")), corners.select(key, F.col("i").alias("j"), F.col("x").alias("bx"), F.col("y").alias("b_y"))
    d = F.round(G.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("b_y")), 9)
    far = a.join(b, key).where("i < j").groupBy(key).agg(F.max(F.struct(d.alias("d"), (-F.col("i")).alias("i"), (-F.col("j")).alias("j"), (F.col("bx") - F.col("ax")).alias("dx"), (F.col("b_y") - F.col("ay")).alias("dy"))).alias("f"))
    return far.select(key, F.pmod(F.degrees(F.atan2("f.dy", "f.dx")), F.lit(180.0)).alias("angle"))


def collinear_groups(dashes: DataFrame, angle: float = 5.0, offset: float = 15.0, reach: float = 40.0) -> DataFrame:
    """Dashes (page, dash_id, cx, cy, angle) grouped in order with the first group that they continue.

    A dash continues a group if it differs by less than ``angle`` from the mean of the group's
    angles, by less than ``offset`` from the mean distance of its centres from the origin across
    that direction, and lies less than ``reach`` from one of its centres.  Order matters, so a
    page is one task's fold over its dashes.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dash_id")
        groups, out = [], []  # sum of angles, centres
        for d in pdf.itertuples():
            here = np.array([d.cx, d.cy])
            for k, (total, centres) in enumerate(groups):
                mean = total / len(centres)
                apart = abs(d.angle - mean)
                if min(apart, 180 - apart) >= angle:
                    continue
                across = np.array([math.sin(math.radians(mean)), -math.cos(math.radians(mean))])
                at = np.array(centres)
                if abs(here @ across - (at @ across).mean()) < offset and np.hypot(*(at - here).T).min() < reach:
                    groups[k] = (total + d.angle, [*centres, here])
                    out.append(k)
                    break
            else:
                out.append(len(groups))
                groups.append((d.angle, [here]))
        return pd.DataFrame({"page": pdf["page"].iloc[0], "dash_id": pdf["dash_id"].to_numpy(), "group": out})

    return dashes.groupBy("page").applyInPandas(run, "page int, dash_id long, group int")


def _hull(p: list) -> list:
    """The convex hull of distinct points in the order of (x, y), in order."""
    if len(p) < 3:
        return p
    half = []
    for seq in (p, p[::-1]):
        line: list = []
        for q in seq:
            x, y = q
            while len(line) > 1:
                (ox, oy), (ax, ay) = line[-2], line[-1]
                if not (ax - ox) * (y - oy) - (ay - oy) * (x - ox) <= 0:
                    break
                line.pop()
            line.append(q)
        half += line[:-1]
    return half


def _least_frames(p: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The areas and the corners of the smallest rectangles around hulls that follow each other in ``p``, those of most points first."""
    first = np.cumsum(size) - size
    best, corners = np.zeros(len(size)), np.zeros((len(size), 4, 2))
    # all hulls that have a k-th side try it at once; they are the first m
    for k in range(size[0]):
        m = np.searchsorted(-size, -k)
        own, at = size[:m], first[:m]
        side = p[at + (k + 1) % own] - p[at + k]
        norm = np.hypot(*side.T)
        flat = ~(norm > 0)
        ux, uy = np.where(flat, 1.0, side[:, 0] / np.where(flat, 1.0, norm)), np.where(flat, 0.0, side[:, 1] / np.where(flat, 1.0, norm))
        (x, y), wx, wy = p[: own.sum()].T, np.repeat(ux, own), np.repeat(uy, own)
        s, t = x * wx + y * wy, y * wx - x * wy
        (s0, s1), (t0, t1) = ((np.minimum.reduceat(c, at), np.maximum.reduceat(c, at)) for c in (s, t))
        area = (s1 - s0) * (t1 - t0)
        on = np.flatnonzero((area < best[:m] - 1e-9) | (k == 0))
        best[on] = area[on]
        for j, (a, b) in enumerate(((s0, t0), (s1, t0), (s1, t1), (s0, t1))):
            corners[on, j, 0], corners[on, j, 1] = (a * ux - b * uy)[on], (a * uy + b * ux)[on]
    return best, corners


def smallest_rectangles(points: DataFrame, key: str) -> DataFrame:
    """(key, i, x, y, area): the four corners of the rotated rectangle of least area around each group of points.

    One of its sides lies on a side of the convex hull; each row of points is first cut to its two ends.  A group is
    within one task, which does many small ones side by side.  ``points`` are read twice.
    """
    ends = points.groupBy(key, "y").agg(*[f("x").cast("double").alias(c) for c, f in (("a", F.min), ("b", F.max))]).withColumn("y", F.col("y").cast("double"))

    def run(rows: pa.Table) -> pa.Table:
        names = rows.column(key).combine_chunks().dictionary_encode("encode")
        y, a, b = (rows.column(c).to_numpy() for c in ("y", "a", "b"))
        group, p = np.tile(names.indices.to_numpy(), 2), np.column_stack([np.r_[a, b], np.tile(y, 2)])
        order = np.lexsort((p[:, 1], p[:, 0], group))
        group, p = group[order], p[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (p[1:] != p[:-1]).any(1)]
        group, p = group[new], p[new]
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        every = p.tolist()
        hulls = [_hull(every[j:k]) for j, k in zip(start.tolist(), [*start[1:].tolist(), len(every)])]
        size = np.array([len(h) for h in hulls])
        order = np.argsort(-size, kind="stable")
        area, corners = _least_frames(np.array([q for k in order for q in hulls[k]]), size[order])
        x, y = corners.reshape(-1, 2).T
        i = np.tile(np.arange(4, dtype=np.int32), len(order))
        return pa.table({key: names.dictionary.take(pa.array(np.repeat(group[start][order], 4))), "i": i, **{c: pa.array(v, from_pandas=True) for c, v in (("x", x), ("y", y), ("area", np.repeat(area, 4)))}})

    shares = graph.dealt(ends, key, rows=graph.PIXELS, n=points.count())
    return shares.applyInArrow(run, f"{key} {dict(points.dtypes)[key]}, i int, x double, y double, area double")


def simplified(polygons: DataFrame, key: str, share: float = 0.005) -> DataFrame:
    """Polygons with the points that lie within a share of the outline's length of the chords left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("i")[["x", "y"]].to_numpy(float)
        ring = np.concatenate([p, p[:1]])
        least = share * float(np.hypot(*np.diff(ring, axis=0).T).sum())
        far = int(np.argmax(np.hypot(*(p - p[0]).T)))
        keep, todo = {0, far}, [(0, far), (far, len(p))]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            d = ring[b] - ring[a]
            q = ring[a + 1 : b] - ring[a]
            norm = float(np.hypot(*d))
            gap = np.hypot(*q.T) if norm < 1e-12 else np.abs(d[0] * q[:, 1] - d[1] * q[:, 0]) / norm
            k = int(np.argmax(gap))
            if gap[k] > least:
                keep.add(a + 1 + k)
                todo += [(a, a + 1 + k), (a + 1 + k, b)]
        at = sorted(keep)
        return pd.DataFrame({key: pdf[key].iloc[0], "i": range(len(at)), "x": p[at, 0], "y": p[at, 1]})

    return polygons.select(key, "i", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).groupBy(key).applyInPandas(run, f"{key} {dict(polygons.dtypes)[key]}, i int, x double, y double")


def containing(polygons: DataFrame, x: float, y: float, key: str, least: float = 0.0) -> DataFrame:
    """The tightest polygon over an area around a point, by crossings of the ray to the right."""
    w = Window.partitionBy(key).orderBy("i")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = polygons.withColumn("bx", F.coalesce(F.lead("x").over(w), F.first("x").over(every))).withColumn("b_y", F.coalesce(F.lead("y").over(w), F.first("y").over(every)))
    at = F.col("x") + (y - F.col("y")) * (F.col("bx") - F.col("x")) / F.nullif(F.col("b_y") - F.col("y"), F.lit(0.0))
    hits = e.groupBy(key).agg(F.count_if(((F.col("y") > y) != (F.col("b_y") > y)) & (at > x)).alias("hits"))
    area = curves.shoelace_area(polygons, key)
    return hits.where("hits % 2 = 1").join(area, key).where(F.col("area") > least).orderBy("area", key).limit(1).select(key, "area")


def arc_sides(arcs: DataFrame, centres: DataFrame, key: str = "path_id") -> DataFrame:
    """(key, arc, radius, side): of the two arcs (key, arc, x, y) of each path the one nearer to its bend's centre (key, cx, cy) on average is inner."""
    at = arcs.join(centres.select(key, "cx", "cy"), key)
    r = at.groupBy(key, "arc").agg(F.avg(G.distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"))).alias("radius"))
    return r.withColumn("side", F.when(F.row_number().over(Window.partitionBy(key).orderBy("radius", "arc")) == 1, "inner").otherwise("outer"))


def _start_trimmed(lines: DataFrame, angle: float, reach: float, span: int, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("i")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = curves.arc_length(lines, key).withColumn("n", F.count(F.lit(1)).over(every)).withColumn("total", F.max("d").over(every))
    d = d.withColumn("most", F.least(F.count_if(F.col("d") <= reach).over(every), F.col("n") - 4))
    ax, ay = F.col("x") - F.first("x").over(every), F.col("y") - F.first("y").over(every)
    ahead = lambda c: F.coalesce(F.lead(c, span).over(w), F.last(c).over(every)) - F.col(c)
    d = d.withColumns({"ax": ax, "ay": ay, "bx": ahead("x"), "b_y": ahead("y")})
    size = F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2), F.sqrt(F.col("bx") ** 2 + F.col("b_y") ** 2)
    cos = G.clamp((F.col("ax") * F.col("bx") + F.col("ay") * F.col("b_y")) / F.nullif(size[0] * size[1], F.lit(0.0)), -1.0, 1.0)
    turned = (size[0] >= 1e-6) & (size[1] >= 1e-6) & (F.acos(cos) >= math.radians(angle))
    fit = (F.col("n") >= 8) & (F.col("total") > reach) & (F.col("most") >= 3) & F.col("i").between(F.lit(2), F.col("most")) & turned
    at = d.where(fit).groupBy(key).agg(F.max("i").alias("from"))
    cut = lines.join(at, key, "left").where("from is null or i >= from")
    return cut.select(key, (F.col("i") - F.coalesce("from", F.lit(0))).alias("i"), "x", "y")


def _reversed(lines: DataFrame, key: str) -> DataFrame:
    return lines.select(key, (F.max("i").over(Window.partitionBy(key)) - F.col("i")).alias("i"), "x", "y")


def hooks_trimmed(lines: DataFrame, angle: float, reach: float, span: int = 6, key: str = "path_id") -> DataFrame:
    """Curves without the hooks at their ends.

    A curve begins at the last point within ``reach`` of its start from which the way ahead
    (``span`` points) turns by ``angle`` degrees or more from the way so far; then its other end
    likewise.  Curves of fewer than eight points, or no longer than ``reach``, stay.
    """
    if reach <= 0:
        return lines.select(key, "i", "x", "y")
    once = _start_trimmed(lines, angle, reach, span, key)
    return _reversed(_start_trimmed(_reversed(once, key), angle, reach, span, key), key)


def measured_lengths(strips: DataFrame, m_per_px: float) -> DataFrame:
    """Lengths of strips (area_px, skeleton_px, width_px, ...) in metres: along the skeleton, half the outline if ``skeleton_px`` is one, and the area by the mean width (null without)."""
    by_width = F.col("area_px") / F.when(F.col("width_px") > 0, F.col("width_px")) * m_per_px
    return strips.withColumn("skeleton_m", F.col("skeleton_px") * m_per_px).withColumn("outline_m", F.col("skeleton_px") / 2 * m_per_px).withColumn("area_m2", F.col("area_px") * m_per_px**2).withColumn("by_width_m", by_width)


def transformed(points: DataFrame, scale: float, dx: float = 0.0, dy: float = 0.0, ox: float = 0.0, oy: float = 0.0, turn: float = 0.0) -> DataFrame:
    """Scaled and turned about an origin, then moved."""
    c, s = scale * math.cos(math.radians(turn)), scale * math.sin(math.radians(turn))
    u, v = F.col("x") - ox, F.col("y") - oy
    return points.withColumns({"x": ox + dx + c * u - s * v, "y": oy + dy + s * u + c * v})
