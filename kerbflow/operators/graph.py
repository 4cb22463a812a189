"""Graphs of nodes and edges: components, degrees, paths, seeds.

Edges are (a, b, ...) within a ``page``, the unit of distribution for ordered algorithms: those run as one
grouped function a page, on arrays.  Everything that is not inherently ordered is joins.
"""

from __future__ import annotations

import heapq
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.functions import geometry as G


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, with its lineage cut, in the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="kerbflow-"))
    return df.checkpoint()


#: Rows of a task where each becomes many, and where they are only joined or summed; pixels of a task.
FEW, MANY, PIXELS = 20_000, 400_000, 1 << 19


def spread(df: DataFrame, *keys: str, rows: int = FEW, n: int | None = None) -> DataFrame:
    """``df``, of ``n`` rows (else counted), dealt out by ``keys`` so that a task's share stays the same however large it is."""
    n = df.count() if n is None else n
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-n // rows)), *keys)


def dealt(df: DataFrame, *keys: str, rows: int, n: int | None = None):
    """``df`` grouped into shares of about ``rows`` rows, of ``n`` in all (else counted): rows of one key stay together, many keys make up a share.

    For functions that work on many small groups at once; ``share`` is a further column, and each share a partition.
    """
    n = df.count() if n is None else n
    shares = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // rows))
    return df.withColumn("share", F.pmod(F.xxhash64(*keys), F.lit(shares)).cast("int")).repartitionById(shares, F.col("share")).groupBy("share")


def every_place(pixels: DataFrame, size: tuple[int, int]) -> DataFrame:
    """(page, y, x): all places of an image of a size, for each page of ``pixels``, dealt out before rows become places and after.

    ``pixels`` are read twice.
    """
    pages = pixels.select("page").distinct()
    n = pages.count() * size[0]
    rows = pages.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(size[0] - 1))))
    places = spread(rows, "page", "y", rows=max(1, PIXELS // size[1]), n=n).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(size[1] - 1))))
    return spread(places, "page", "y", "x", rows=PIXELS, n=n * size[1])


def star_components(links: DataFrame, keep=checkpointed) -> DataFrame:
    """(node, component) of the nodes of ``links`` (a, b): the least node that they reach.

    Alternating large-star and small-star steps: rounds grow with the logarithm of a component's
    size, each a few joins whose hot keys Spark can split; a hub is joined with its neighbours
    only, never pairs of them.  ``keep`` computes a table once and cuts its lineage.  Isolated
    nodes do not occur in ``links`` and so not in the result; self links and repeats are harmless.
    """

    def told(edge: DataFrame) -> tuple:
        return tuple(edge.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edge = keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = told(edge)  # links that are stars already take one round, none at all no round
    while state[0]:
        both = edge.union(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        star = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        hop = star.join(low, "u")
        edge = hop.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(hop.select("u", F.col("m").alias("v"))).distinct()
        edge = keep(edge.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = told(edge)
        if now == state:
            break
        state = now
    tops = edge.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edge.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) for all ``nodes`` (node): the least node that edges (a, b) reach."""
    found = star_components(edges.select("a", "b"))
    return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, degree), 0 for isolated nodes, by one sum instead of a join."""
    row = lambda n, own: [F.lit(n).cast("long").alias("n"), F.lit(own).alias("own")]
    ends = edges.select(F.col("a").alias("node"), *row(1, False)).union(edges.select("b", *row(1, False)))
    every = spread(nodes.select("node", *row(0, True)).union(ends), "node", rows=MANY, n=4 * edges.count())
    return every.groupBy("node").agg(F.sum("n").alias("degree"), F.max("own").alias("own")).where("own").drop("own")


def largest_component(labels: DataFrame) -> DataFrame:
    """The nodes of the largest component; of equals the one with the least label."""
    size = labels.groupBy("component").agg(F.count("*").alias("n"))
    top = size.orderBy(F.desc("n"), "component").limit(1).select("component")
    return labels.join(F.broadcast(top), "component", "left_semi")


def outside_ratio(edges: DataFrame, pixels: DataFrame, samples: int = 40) -> DataFrame:
    """Adds to edges (page, a, b, ax, ay, bx, by) the share of evenly spaced points that are not on a set pixel."""
    t = F.col("k") / (samples - 1)
    put = lambda c: F.bround(F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * t).cast("int")
    dots = edges.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).select("page", "a", "b", put("x").alias("x"), put("y").alias("y"))
    hit = dots.join(pixels.select("page", "y", "x", F.lit(1).alias("on")).distinct(), ["page", "y", "x"], "left")
    ratio = hit.groupBy("page", "a", "b").agg(F.avg(F.when(F.col("on").isNull(), 1.0).otherwise(0.0)).alias("outside_ratio"))
    return edges.join(ratio, ["page", "a", "b"])


def edge_costs(edges: DataFrame, most: float = 95.0, weight: float = 5.0) -> DataFrame:
    return edges.where(F.col("distance") <= most).withColumn("cost", F.col("distance") * (1 + weight * F.col("outside_ratio")))


def greedy_seeds(pixels: DataFrame, least: int) -> DataFrame:
    """Pixels taken row by row, each clearing the disc of radius ``least`` around it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        free, out = np.ones(len(y), bool), []
        for k in range(len(y)):
            if free[k]:
                out.append(k)
                end = np.searchsorted(y, y[k] + least, side="right")  # rows below the disc are out of reach
                free[k:end] &= (y[k:end] - y[k]) ** 2 + (x[k:end] - x[k]) ** 2 > least * least
        return pd.DataFrame({"page": pdf["page"].to_numpy()[out], "seed": np.arange(len(out)), "x": x[out], "y": y[out]})

    return pixels.select("page", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).groupBy("page").applyInPandas(run, "page int, seed long, x long, y long")


def path_edges(edges: DataFrame) -> DataFrame:
    """Kruskal's forest of edges (page, a, b, cost) in which no node has more than two."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cost", "a", "b"])
        top, degree, keep = {}, {}, []

        def root(v):
            while top.setdefault(v, v) != v:
                top[v] = top[top[v]]
                v = top[v]
            return v

        for a, b in zip(pdf["a"], pdf["b"]):
            r, s = root(a), root(b)
            ok = r != s and degree.get(a, 0) < 2 and degree.get(b, 0) < 2
            keep.append(ok)
            if ok:
                top[r] = s
                degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
        return pdf[np.array(keep, bool)]

    slim = edges.select("page", "a", "b", "cost")
    return slim.groupBy("page").applyInPandas(run, slim.schema)


def _neighbours(a, b, cost) -> dict:
    out: dict = {}
    for p, q, c in zip(a, b, cost):
        out.setdefault(p, []).append((q, c))
        out.setdefault(q, []).append((p, c))
    return out


def _distances(start, near: dict) -> tuple[dict, dict]:
    best, before, heap = {start: 0.0}, {}, [(0.0, start)]
    while heap:
        d, v = heapq.heappop(heap)
        if d > best[v]:
            continue
        for q, c in near.get(v, ()):
            if d + c < best.get(q, np.inf):
                best[q], before[q] = d + c, v
                heapq.heappush(heap, (d + c, q))
    return best, before


def shortest_distances(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(page, node, distance) from each page's start node; nodes out of reach do not occur."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        near = _neighbours(left["a"], left["b"], left["cost"])
        rows = []
        for s in sorted(right["node"]):
            best, _ = _distances(s, near)
            rows += [(key[0], s, v, d) for v, d in best.items()]
        return pd.DataFrame(rows, columns=["page", "start", "node", "distance"])

    return edges.select("page", "a", "b", "cost").groupBy("page").cogroup(starts.select(F.col("page").cast("int").alias("page"), F.col("node").cast("long").alias("node")).groupBy("page")).applyInPandas(run, "page int, start long, node long, distance double")


def main_path(edges: DataFrame) -> DataFrame:
    """The path between far ends of each page's graph, by two sweeps from the least node.

    Of nodes equally far (to nine places) the smaller one counts.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near = _neighbours(pdf["a"], pdf["b"], pdf["cost"])
        best, _ = _distances(min(near), near)
        one = min(best, key=lambda v: (-round(best[v], 9), v))
        best, before = _distances(one, near)
        end = min(best, key=lambda v: (-round(best[v], 9), v))
        walk = [end]
        while walk[-1] != one:
            walk.append(before[walk[-1]])
        walk = walk[::-1]
        return pd.DataFrame({"page": pdf["page"].iloc[0], "i": np.arange(len(walk)), "node": walk, "distance": [best[v] for v in walk]})

    return edges.select("page", "a", "b", "cost").groupBy("page").applyInPandas(run, "page int, i long, node long, distance double")


def ordered_walk(edges: DataFrame) -> DataFrame:
    """Nodes of each page's simple paths in order, from the end with the smaller id; rings are cut there."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near = _neighbours(pdf["a"], pdf["b"], np.ones(len(pdf)))
        seen, rows, chain = set(), [], 0
        for s in [*sorted(v for v in near if len(near[v]) == 1), *sorted(near)]:
            if s in seen:
                continue
            v, i = s, 0
            while v is not None:
                seen.add(v)
                rows.append((pdf["page"].iloc[0], chain, i, v))
                v, i = min((q for q, _ in near[v] if q not in seen), default=None), i + 1
            chain += 1
        return pd.DataFrame(rows, columns=["page", "chain", "i", "node"])

    return edges.select("page", "a", "b").groupBy("page").applyInPandas(run, "page int, chain long, i long, node long")


def pixel_graph(pixels: DataFrame) -> DataFrame:
    """Edges between neighbouring set pixels in eight directions, by equi-joins on four offsets."""
    p = pixels.select("page", "y", "x").distinct()
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])
    ahead = p.withColumn("o", F.explode(offsets)).select("page", F.col("y").alias("ay"), F.col("x").alias("ax"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    cost = F.when((F.col("ay") != F.col("y")) & (F.col("ax") != F.col("x")), F.sqrt(F.lit(2.0))).otherwise(1.0)
    return ahead.join(p, ["page", "y", "x"]).select("page", "ay", "ax", F.col("y").alias("by"), F.col("x").alias("bx"), cost.alias("cost"))


def skeleton_length(pixels: DataFrame) -> DataFrame:
    return pixel_graph(pixels).groupBy("page").agg(F.sum("cost").alias("length"))


def forward_progress(lines: DataFrame, key: str = "path_id", nudge: float = 0.0) -> DataFrame:
    """Points (key, i, x, y, tx, ty) that do not fall back along the tangent of the curve.

    Each point is measured from the one returned before; where it falls back it is put level
    with it, and ``nudge`` further.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        p, t = pdf[["x", "y"]].to_numpy(float), pdf[["tx", "ty"]].to_numpy(float)
        for k in range(1, len(p)):
            ahead = float((p[k] - p[k - 1]) @ t[k])
            if ahead < 0:
                p[k] += (nudge - ahead) * t[k]
        return pdf.assign(x=p[:, 0], y=p[:, 1])

    slim = lines.select(key, "i", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "tx", "ty")
    return slim.groupBy(key).applyInPandas(run, slim.schema)


def progress_along(lines: DataFrame, centre: DataFrame, key: str = "path_id") -> DataFrame:
    """Side lines that do not fall back along the steps of their centreline, station by station."""
    w = Window.partitionBy(key).orderBy("i")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    step = centre.select(key, "i", dx.alias("dx"), dy.alias("dy")).withColumn("size", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    part = lambda c: F.when(F.col("size") >= 1e-9, F.col(c) / F.nullif("size", F.lit(0.0))).otherwise(0.0)
    along = lines.select(key, "i", "x", "y").join(step.select(key, "i", part("dx").alias("tx"), part("dy").alias("ty")), [key, "i"])
    return forward_progress(along, key, 1e-6).select(key, "i", "x", "y")


#: Candidates of a task.
CANDIDATES = 1 << 20


def offset_fit(candidates: DataFrame, smooth: float = 0.6, bias: float = 0.01, key: str = "path_id") -> DataFrame:
    """One offset a station from candidates (key, i, cap, offset, cost), each weighed against the one chosen before.

    The total is the cost, ``smooth`` times the step from the offset before and ``bias`` times
    the offset; candidates beyond ``cap``, the way to the first boundary, do not count.  The
    first offset starts from 0, of equal totals the smaller counts.  A station without a cap
    (null) has no offset and leaves the one before as it is; one with a cap of 0 resets it.
    A path is within one task, which does many paths side by side.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        line, _ = pd.factorize(pdf[key], use_na_sentinel=False)
        order = np.lexsort((pdf["offset"], pdf["i"], line))
        line, pdf = line[order], pdf.iloc[order]
        i, caps, offsets, costs = (pdf[c].to_numpy() for c in ("i", "cap", "offset", "cost"))
        new = np.r_[True, (line[1:] != line[:-1]) | (i[1:] != i[:-1])]
        start = np.flatnonzero(new)
        count, cap, line = np.diff(np.r_[start, len(i)]), caps[start], line[start]
        first = np.r_[True, line[1:] != line[:-1]]
        turn = np.arange(len(start)) - np.maximum.accumulate(np.where(first, np.arange(len(start)), 0))
        before, chosen = np.zeros(line.max() + 1), np.zeros(len(start))
        by_turn = np.argsort(turn, kind="stable")
        # all paths of the share take their next station at once
        for at in np.split(by_turn, np.flatnonzero(np.diff(turn[by_turn])) + 1):
            k = np.arange(count[at].max())
            row = np.minimum(start[at][:, None] + k, len(i) - 1)
            d, b = offsets[row], before[line[at]]
            fit = (k < count[at][:, None]) & (d <= cap[at][:, None])
            total = np.where(fit, costs[row] + smooth * np.abs(d - b[:, None]) + bias * d, np.inf)
            best = total.argmin(1)
            best = np.where(np.isinf(total[np.arange(len(at)), best]), fit.argmax(1), best)
            kept = np.where((cap[at] > 1e-9) & fit.any(1), d[np.arange(len(at)), best], 0.0)
            none = np.isnan(cap[at])
            before[line[at]] = np.where(none, b, kept)
            chosen[at] = np.where(none, np.nan, kept)
        return pdf[[key, "i"]].iloc[start].assign(offset=pd.Series(chosen).astype("Float64").mask(np.isnan(cap)).to_numpy(object, na_value=None))

    slim = candidates.select(key, "i", *[F.col(c).cast("double").alias(c) for c in ("cap", "offset", "cost")])
    return dealt(slim, key, rows=CANDIDATES).applyInPandas(run, f"{key} {dict(slim.dtypes)[key]}, i {dict(slim.dtypes)['i']}, offset double")


#: Points that are weighed at once.
TRIED = 200_000


def scale_search(
    paths: DataFrame, field: DataFrame, origins: DataFrame, scales=(0.85, 1.0), moves_y=(-80.0, 80.0), moves_x=(-80.0, 80.0), first=(61, 17), then: int = 31, rounds: int = 4,
    outside: float = 1000.0, mean_weight: float = 0.25, end_weight: float = 500.0, nth: int = 8, lock_ends: bool = True,
) -> DataFrame:
    """(page, scale, dy, dx, objective): how the path of each page, scaled about its origin and moved, lies best on the edge of a mask.

    Paths are (page, i, x, y), origins (page, cx, cy), the field (page, y, x, v, inside) holds the
    distance to the edge and whether a pixel is in the mask.  The objective is the median edge distance
    of every ``nth`` point inside, some of its mean, and what points outside and ends that leave
    their height cost.  With ``lock_ends`` the move keeps the mean height of the ends.  A grid of scales and
    moves is narrowed round by round to two steps either side of the best; the first of equals counts.  A page is
    within one task, which does many small ones.
    """

    def one(path, origin, ys, xs, values, inside):
        few = path[::nth] if np.allclose(path[::nth][-1], path[-1]) else np.vstack([path[::nth], path[-1]])
        h, w = int(ys.max()) + 1, int(xs.max()) + 1
        edge, held = np.full((h, w), 1e6), np.zeros((h, w), bool)
        edge[ys, xs], held[ys, xs] = values, inside

        def weigh(scale, dy, dx):
            q = origin + scale * (few - origin) + (dy, dx)
            y, x = q.T
            on = (y >= 0) & (x >= 0) & (y <= h - 1) & (x <= w - 1)
            y, x = y.clip(0, h - 1), x.clip(0, w - 1)
            a, b = np.floor(y).astype(int), np.floor(x).astype(int)
            c, d = np.minimum(a + 1, h - 1), np.minimum(b + 1, w - 1)
            u, v = y - a, x - b
            gap = np.where(on, (edge[a, b] * (1 - v) + edge[a, d] * v) * (1 - u) + (edge[c, b] * (1 - v) + edge[c, d] * v) * u, 1e6)
            r, s = np.round(q[:, 0]).astype(int), np.round(q[:, 1]).astype(int)
            sound = (r >= 0) & (s >= 0) & (r < h) & (s < w)
            inner = np.zeros(len(q), bool)
            inner[sound] = held[r[sound], s[sound]]
            ends = np.abs(origin[0] + scale * (path[[0, -1], 0] - origin[0]) + dy - path[[0, -1], 0]).max()
            near = (np.median(gap[inner]), gap[inner].mean()) if inner.any() else (1e6, 1e6)
            return near[0] + mean_weight * near[1] + outside * (~inner).sum() / max(1, len(path)) + end_weight * ends

        def screened(tried):
            """``weigh`` for many at once, but for the last bits."""
            scale, move = tried[:, 0, None, None], tried[:, None, 1:]
            y, x = np.moveaxis(origin + scale * (few - origin) + move, 2, 0)
            r, s = np.round(y).astype(int), np.round(x).astype(int)
            on, sound = (y >= 0) & (x >= 0) & (y <= h - 1) & (x <= w - 1), (r >= 0) & (s >= 0) & (r < h) & (s < w)
            y, x = y.clip(0, h - 1), x.clip(0, w - 1)
            a, b = np.floor(y).astype(int), np.floor(x).astype(int)
            c, d = np.minimum(a + 1, h - 1), np.minimum(b + 1, w - 1)
            u, v = y - a, x - b
            gap = np.where(on, (edge[a, b] * (1 - v) + edge[a, d] * v) * (1 - u) + (edge[c, b] * (1 - v) + edge[c, d] * v) * u, 1e6)
            inner = sound & held[r.clip(0, h - 1), s.clip(0, w - 1)]
            n, row = inner.sum(1), np.arange(len(tried))
            low = np.sort(np.where(inner, gap, np.inf), 1)
            middle = (low[row, np.maximum(n - 1, 0) // 2] + low[row, np.minimum(n // 2, len(few) - 1)]) / 2
            near = np.where(n > 0, middle, 1e6) + mean_weight * np.where(n > 0, np.where(inner, gap, 0.0).sum(1) / np.maximum(n, 1), 1e6)
            tips = path[[0, -1], 0]
            ends = np.abs(origin[0] + tried[:, :1] * (tips - origin[0]) + tried[:, 1:2] - tips).max(1)
            return near + outside * (len(few) - n) / max(1, len(path)) + end_weight * ends

        limits = [scales, moves_y, moves_x]
        spans = [tuple(map(float, z)) for z in limits]
        tips = path[[0, -1], 0]
        for k in range(rounds + 1):
            counts = [max(3, first[0] if k == 0 else then), *[max(3, first[1] if k == 0 else then)] * 2]
            grids = [np.linspace(*z, n) for z, n in zip(spans, counts)]
            ys = [[tips.mean() - (origin[0] + z * (tips - origin[0])).mean()] if lock_ends else grids[1] for z in grids[0]]
            tried = np.array([(z, dy, dx) for z, own in zip(grids[0], ys) for dy in own for dx in grids[2]])
            if np.isfinite(edge).all():
                size = max(1, TRIED // len(few))
                total = np.concatenate([screened(tried[j : j + size]) for j in range(0, len(tried), size)])
                tried = tried[total <= total.min() + 1e-9 * max(1.0, abs(total.min()))]
            best = None
            for scale, dy, dx in tried:
                total = weigh(scale, dy, dx)
                if best is None or total < best[0]:
                    best = (total, scale, dy, dx)
            steps = [(z[1] - z[0]) / (n - 1) for z, n in zip(spans, counts)]
            spans = [(max(lim[0], m - 2 * s), min(lim[1], m + 2 * s)) if not (lock_ends and j == 1) else z for j, (z, lim, m, s) in enumerate(zip(spans, limits, best[1:], steps))]
        return best[1], best[2], best[3], best[0]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values(["page", "i"]), right.sort_values("page", kind="stable")
        pages, begin = np.unique(left["page"].to_numpy(), return_index=True)
        end = np.r_[begin[1:], len(left)].astype(int)
        points = left[["y", "x", "cy", "cx"]].to_numpy(float)
        low, high = (np.searchsorted(right["page"].to_numpy(), pages, side=z) for z in ("left", "right"))
        pixel = [right[c].to_numpy(t) for c, t in (("y", int), ("x", int), ("v", float), ("inside", bool))]
        rows = [(page, *one(points[a:b, :2], points[a, 2:], *(c[p:q] for c in pixel))) for page, a, b, p, q in zip(pages, begin, end, low, high) if p < q]
        return pd.DataFrame(rows, columns=["page", "scale", "dy", "dx", "objective"])

    own = paths.select(F.col("page").cast("long").alias("page"), "i", "x", "y").join(origins.select(F.col("page").cast("long").alias("page"), "cx", "cy"), "page")
    pixels = field.select(F.col("page").cast("long").alias("page"), "y", "x", "v", "inside")
    n = pixels.count()
    return dealt(own, "page", rows=PIXELS, n=n).cogroup(dealt(pixels, "page", rows=PIXELS, n=n)).applyInPandas(run, "page long, scale double, dy double, dx double, objective double")


def refined_centres(path: DataFrame, field: DataFrame, radius: int = 12, end_radius: int = 4, value: float = 1.0, middle: float = 0.03, move: float = 0.02, bend: float = 0.015, rounds: int = 8, least_move: float = 0.15) -> DataFrame:
    """Points (page, i, x, y) of one path a page, moved to better pixels of ``field`` (page, y, x, v) in the disc around them.

    All points move at once.  A pixel scores its value, less the squared distances from the
    middle of the neighbours and from the point, and the distance from the chord between the
    neighbours, each by its weight; of equal scores the first by (y, x) counts.  The ends search a
    disc of their own, have one neighbour and no chord.  A point without a pixel stays.  Ends
    after ``rounds`` or when the mean move is small; each round is a join by pixel.
    """
    at = path.select("page", "i", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    most = max(radius, end_radius)
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-most, most + 1) for dx in range(-most, most + 1) if dy * dy + dx * dx <= most * most])
    w = Window.partitionBy("page").orderBy("i")
    for _ in range(rounds):
        near = at.withColumns({f"{p}{c}": f(c).over(w) for c in "xy" for p, f in (("p", F.lag), ("n", F.lead))})
        inner = F.col("px").isNotNull() & F.col("nx").isNotNull()
        for c in "xy":
            near = near.withColumn(f"m{c}", F.when(inner, (F.col(f"p{c}") + F.col(f"n{c}")) / 2).otherwise(F.coalesce(f"p{c}", f"n{c}", c)))
        tried = near.withColumn("reach", F.when(inner, radius).otherwise(end_radius)).withColumn("o", F.explode(offsets))
        tried = tried.where(F.col("o.dy") * F.col("o.dy") + F.col("o.dx") * F.col("o.dx") <= F.col("reach") * F.col("reach"))
        tried = tried.withColumn("fx", F.bround("x").cast("int") + F.col("o.dx")).withColumn("fy", F.bround("y").cast("int") + F.col("o.dy"))
        tried = tried.join(field.select("page", F.col("y").alias("fy"), F.col("x").alias("fx"), "v"), ["page", "fy", "fx"])
        square = lambda p, q: (F.col("fx") - F.col(p)) ** 2 + (F.col("fy") - F.col(q)) ** 2
        chord = F.when(inner, G.segment_distance(F.col("fx"), F.col("fy"), F.col("px"), F.col("py"), F.col("nx"), F.col("ny"))).otherwise(0.0)
        score = value * F.col("v") - middle * square("mx", "my") - move * square("x", "y") - bend * chord
        best = tried.groupBy("page", "i").agg(F.max(F.struct(score.alias("s"), (-F.col("fy")).alias("y"), (-F.col("fx")).alias("x"))).alias("best"))
        moved = at.join(best, ["page", "i"], "left").select("page", "i", F.coalesce(-F.col("best.x"), "x").cast("double").alias("nx"), F.coalesce(-F.col("best.y"), "y").cast("double").alias("ny"), "x", "y")
        moved = checkpointed(moved)
        mean = moved.agg(F.avg(F.sqrt((F.col("nx") - F.col("x")) ** 2 + (F.col("ny") - F.col("y")) ** 2))).first()[0]
        at = moved.select("page", "i", F.col("nx").alias("x"), F.col("ny").alias("y"))
        if mean is None or mean < least_move:
            break
    return at


def start_and_end(nodes: DataFrame) -> DataFrame:
    """Adds ``role``: of two end points the topmost (then leftmost) is the start; other counts give none."""
    order = F.row_number().over(Window.partitionBy("page").orderBy("y", "x", "node"))
    n = F.count(F.lit(1)).over(Window.partitionBy("page"))
    return nodes.withColumn("n", n).withColumn("role", F.when(F.col("n") == 2, F.when(order == 1, "start").otherwise("end"))).drop("n")


#: The length of a diagonal step on a grid of costs; a fixed value.
DIAGONAL = 1.4142


def grid_paths(costs: DataFrame, ends: DataFrame, guided: bool = True) -> DataFrame:
    """Ways over pixels (page, y, x, cost) between ends (page, ay, ax, by, bx), in eight directions.  (page, i, y, x, distance)

    A step costs its length by the cost of the pixel it enters, in single precision.  ``guided`` searches by A*
    with the straight distance to the goal, which finds the cheapest way only where no pixel costs less than 1, as
    drawings are traced; without it the way is the cheapest.  Pixels that are not given cannot be entered.
    """

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cost = dict(zip(zip(left["y"].tolist(), left["x"].tolist()), left["cost"].tolist()))
        ring = [(-1, 0, 1.0), (1, 0, 1.0), (0, -1, 1.0), (0, 1, 1.0)] + [(a, b, DIAGONAL) for a in (-1, 1) for b in (-1, 1)]
        rows = []
        for e in right.itertuples(index=False):
            start, goal = (int(e.ay), int(e.ax)), (int(e.by), int(e.bx))
            if start not in cost or goal not in cost:
                continue
            ahead = (lambda p: ((p[0] - goal[0]) ** 2 + (p[1] - goal[1]) ** 2) ** 0.5) if guided else (lambda p: 0.0)  # noqa: B023
            best, before, heap, done = {start: 0.0}, {}, [(ahead(start), start)], set()
            while heap:
                _, v = heapq.heappop(heap)
                if v in done:
                    continue
                done.add(v)
                if v == goal:
                    break
                for dy, dx, length in ring:
                    q = (v[0] + dy, v[1] + dx)
                    if q in cost and q not in done and (d := best[v] + cost[q] * length) < best.get(q, np.inf):
                        best[q], before[q] = float(np.float32(d)), v
                        heapq.heappush(heap, (d + ahead(q), q))
            if goal in done:
                way = [goal]
                while way[-1] != start:
                    way.append(before[way[-1]])
                rows += [(key[0], i, y, x, best[y, x]) for i, (y, x) in enumerate(way[::-1])]
        return pd.DataFrame(rows, columns=["page", "i", "y", "x", "distance"])

    slim = costs.select(F.col("page").cast("int").alias("page"), "y", "x", F.col("cost").cast("double").alias("cost"))
    return slim.groupBy("page").cogroup(ends.select(F.col("page").cast("int").alias("page"), "ay", "ax", "by", "bx").groupBy("page")).applyInPandas(run, "page int, i int, y int, x int, distance double")


def branches_pruned(edges: DataFrame, least: int) -> DataFrame:
    """Edges (page, a, b) without the side branches of at most ``least`` edges that end at a junction, shortest first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(pdf["a"], pdf["b"]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        while True:
            found = []
            for v in sorted(near):
                if len(near[v]) == 1:
                    walk = [v]
                    while len(near[walk[-1]]) <= 2 and (ahead := sorted(near[walk[-1]] - set(walk[-2:]))):
                        walk.append(ahead[0])
                    if len(near[walk[-1]]) > 2 and len(walk) - 1 <= least:
                        found.append((len(walk), walk))
            if not found:
                break
            walk = min(found)[1]
            for p, q in zip(walk, walk[1:]):
                near[p].discard(q)
                near[q].discard(p)
        left = [(a, b) for a, b in zip(pdf["a"], pdf["b"]) if b in near[a]]
        return pd.DataFrame({"page": pdf["page"].iloc[0], "a": [p[0] for p in left], "b": [p[1] for p in left]})

    return edges.select("page", "a", "b").groupBy("page").applyInPandas(run, "page int, a long, b long")


def ends_clipped(edges: DataFrame, clip: float) -> DataFrame:
    """Nodes of each page's main path at least ``clip`` from both of its ends."""
    path = main_path(edges)
    total = F.max("distance").over(Window.partitionBy("page"))
    return path.withColumn("total", total).where((F.col("distance") >= clip) & (F.col("total") - F.col("distance") >= clip)).drop("total")


def upright_pair(distances: DataFrame, share: float = 0.65) -> DataFrame:
    """Of pairs of ends (page, a, b, ay, ax, by, bx, distance) not much shorter than the longest, the most upright one."""
    longest = F.max("distance").over(Window.partitionBy("page"))
    score = F.abs(F.col("by") - F.col("ay")) / (1 + F.abs(F.col("bx") - F.col("ax")))
    fit = distances.withColumn("most", longest).where(F.col("distance") >= share * F.col("most"))
    return fit.groupBy("page").agg(F.max(F.struct(score.alias("score"), (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))).alias("m")).select("page", (-F.col("m.a")).alias("a"), (-F.col("m.b")).alias("b"), F.col("m.score").alias("score"))


#: Side of the squares in which components are found at once.
SQUARE = 512


def _least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of ``n`` numbers that each reaches by the links a, b: higher tops hang below lower ones until no link has two."""
    top = np.arange(n)
    while len(a):
        low, high = np.minimum(top[a], top[b]), np.maximum(top[a], top[b])
        on = low < high
        a, b = a[on], b[on]
        np.minimum.at(top, high[on], low[on])
        while (top[top] != top).any():
            top = top[top]
    return top


def labelled(pixels: DataFrame, neighbours: int = 8) -> DataFrame:
    """Pixels (page, y, x) with their ``component`` by four or eight neighbours: a number that orders a page's pixels by (y, x).

    Pages are below nine million, columns below a million.  Components are found within squares first, many
    squares a task; only the links between the parts at the squares' edges are left to the rounds of joins.
    """
    node = lambda y, x: F.col(y).cast("long") * 1_000_000 + F.col(x) + F.col("page").cast("long") * 1_000_000_000_000
    square = lambda c: F.floor(F.col(c) / SQUARE)
    p = checkpointed(pixels.select("page", "y", "x").distinct())
    ahead = [(0, 1), (1, 0)] if neighbours == 4 else [(0, 1), (1, -1), (1, 0), (1, 1)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = 2 * SQUARE
        at = pdf.groupby(["page", "sy", "sx"]).ngroup().to_numpy() * wide * wide + (pdf["y"].to_numpy(np.int64) % SQUARE + 1) * wide + pdf["x"].to_numpy(np.int64) % SQUARE + 1
        order = np.argsort(at)
        at, name, links = at[order], pdf["node"].to_numpy()[order], []
        for dy, dx in ahead:
            near = np.searchsorted(at, at + dy * wide + dx).clip(max=len(at) - 1)
            here = np.flatnonzero(at[near] == at + dy * wide + dx)
            links.append((here, near[here]))
        top = _least_reached(len(at), *map(np.concatenate, zip(*links)))
        return pdf.iloc[order].assign(component=name[top])[["page", "y", "x", "component"]]

    named = p.select("page", "y", "x", node("y", "x").alias("node"), square("y").alias("sy"), square("x").alias("sx"))
    kind = ", ".join(f"{c} {t}" for c, t in p.dtypes) + ", component long"
    parts = checkpointed(dealt(named, "page", "sy", "sx", rows=PIXELS, n=p.count()).applyInPandas(run, kind))
    rim = parts.where(" or ".join(f"pmod({c}, {SQUARE}) in (0, {SQUARE - 1})" for c in "yx"))
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ahead])
    over = rim.withColumn("o", F.explode(steps)).select("page", F.col("y").alias("ay"), F.col("x").alias("ax"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.col("component").alias("a"))
    over = over.where((square("ay") != square("y")) | (square("ax") != square("x")))
    links = checkpointed(over.join(rim, ["page", "y", "x"]).select("a", F.col("component").alias("b")).distinct())
    if links.isEmpty():
        return parts
    tops = star_components(links).select(F.col("node").alias("component"), F.col("component").alias("top"))
    return parts.join(tops, "component", "left").select("page", "y", "x", F.coalesce("top", "component").alias("component"))


def flooded(background: DataFrame, seeds: DataFrame) -> DataFrame:
    """Background pixels (page, y, x) joined to a seed's pixel in four directions, by components."""
    all_of = labelled(background, 4)
    hit = all_of.join(seeds.select("page", "y", "x"), ["page", "y", "x"], "left_semi").select("component").distinct()
    return all_of.join(hit, "component", "left_semi").select("page", "y", "x")
