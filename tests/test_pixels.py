"""Tiles, skeletons, isolines, outlines and boundaries against plain versions, on the driver tables and on made-up masks."""

import heapq
import math
import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbflow.operators import boundary, graph, isolines, raster, stats, tiles
from kerbflow.plans import pixels as plans
from kerbflow.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def by_page(df, *columns):
    out = defaultdict(dict)
    for r in df.collect():
        out[r.page][r.y, r.x] = tuple(r[c] for c in columns) if len(columns) > 1 else (r[columns[0]] if columns else None)
    return dict(out)


def blobs(spark, seed=0, size=40, share=0.72):
    r = random.Random(seed)
    rows = [(page, y, x) for page in (3, 8) for y in range(size) for x in range(size) if r.random() < share and (y - 20) ** 2 + (x - 20) ** 2 < 380]
    rows += [(8, y, x) for y in range(-5, 0) for x in range(-7, 30)] + [(9, 4, 4)] + [(10, 0, x) for x in range(50)]
    return spark.createDataFrame([*rows, rows[0]], "page int, y int, x int")


# -- tiles ----------------------------------------------------------------------------------


def test_distances(spark):
    m = blobs(spark)
    want = by_page(raster.distance_transform(m), "v")
    for band in (3, 64):
        got = by_page(tiles.distances(m, band=band), "v")
        assert {p: {k: pytest.approx(v) for k, v in q.items()} for p, q in want.items()} == got
    inside = m.where("y >= 0 and y < 30 and x >= 0 and x < 31")
    pages = by_page(inside)
    got = by_page(tiles.distances(inside, (30, 31), 7), "v")
    for page, own in pages.items():
        off = [(y, x) for y in range(30) for x in range(31) if (y, x) not in own]
        for y, x in own:
            assert got[page][y, x] == pytest.approx(min(math.hypot(y - a, x - b) for a, b in off))
    full = spark.createDataFrame([(1, y, x) for y in range(4) for x in range(5)], "page int, y int, x int")
    assert all(r.v == math.inf for r in tiles.distances(full, (4, 5)).collect())
    assert tiles.opening_residues(full, (4, 5)).count() == 0


def test_opening_residues(spark):
    size = (30, 40)
    m = blobs(spark).where("y >= 0 and y < 30 and x >= 0 and x < 40")
    got = by_page(tiles.opening_residues(m, size))
    cross = [(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)]
    for page, own in by_page(m).items():
        inside = lambda p: 0 <= p[0] < size[0] and 0 <= p[1] < size[1]
        at, out = set(own), set()
        while at:
            less = {p for p in at if all((p[0] + a, p[1] + b) in at for a, b in cross if inside((p[0] + a, p[1] + b)))}
            out |= at - {(p[0] + a, p[1] + b) for p in less for a, b in cross}
            at = less
        assert set(got.get(page, {})) == out


@pytest.mark.parametrize("tile,passes", [(8, 1), (8, 4), (13, 3), (64, 8)])
def test_thinned(spark, tile, passes):
    m = blobs(spark, 1, share=0.93)
    assert by_page(tiles.thinned(m, tile, passes)) == by_page(raster.skeleton(m))


def plain_axis(own):
    """In one order, pixel by pixel."""
    field = {p: min(math.hypot(p[0] - y, p[1] - x) for y in range(p[0] - 25, p[0] + 26) for x in range(p[1] - 25, p[1] + 26) if (y, x) not in own) for p in own}
    left = set(own)
    corner = {p: 8 - sum((p[0] + a, p[1] + b) in own for a, b in EIGHT) for p in own}
    for p in sorted(own, key=lambda p: (field[p], corner[p], p)):
        ring = {(p[0] + a, p[1] + b) for a, b in EIGHT} & left
        if len(ring) >= 2:
            reach, rest = [min(ring)], set(ring) - {min(ring)}
            while reach:
                q = reach.pop()
                near = {(q[0] + a, q[1] + b) for a, b in EIGHT} & rest
                rest -= near
                reach += near
            if not rest:
                left.discard(p)
    return {p: field[p] for p in left}


@pytest.mark.parametrize("tile", [7, 16, 64])
def test_medial_axis(spark, tile):
    m = blobs(spark, 2, share=0.95)
    want = {page: {p: pytest.approx(v) for p, v in plain_axis(set(own)).items()} for page, own in by_page(m).items()}
    assert by_page(tiles.medial_axis(m, tile), "v") == want


@tables
def test_medial_axis_query(spark):
    got = by_page(QUERIES["medial_axis"](spark, SF), "v")
    for page, own in by_page(plans.ml(spark, SF)).items():
        want = plain_axis(set(own))
        assert set(got[page]) == set(want)
        assert all(abs(v - want[p]) < 1e-3 for p, v in got[page].items())


@tables
def test_thinned_query(spark):
    assert by_page(QUERIES["thinned_by_tiles"](spark, SF)) == by_page(raster.skeleton(plans.ml(spark, SF).withColumn("page", F.col("page").cast("int"))))


@pytest.mark.parametrize("tile,least", [(8, 3), (5, 5), (64, 4)])
def test_disc_seeds(spark, tile, least):
    m = blobs(spark, 3)
    want = sorted((r.page, r.seed, r.y, r.x) for r in graph.greedy_seeds(m.distinct(), least).collect())
    assert sorted(tuple(r) for r in tiles.disc_seeds(m, least, tile).collect()) == want


def heap_ways(own, starts):
    best, heap = dict.fromkeys(starts, 0.0), [(0.0, s) for s in starts]
    heapq.heapify(heap)
    while heap:
        d, p = heapq.heappop(heap)
        if d > best[p]:
            continue
        for a, b in EIGHT:
            q = (p[0] + a, p[1] + b)
            if q in own and d + math.hypot(a, b) < best.get(q, math.inf) - 1e-12:
                best[q] = d + math.hypot(a, b)
                heapq.heappush(heap, (best[q], q))
    return best


@pytest.mark.parametrize("tile", [6, 64])
def test_geodesics(spark, tile):
    m = blobs(spark, 4, share=0.6)
    starts = {3: [(20, 20), (5, 18)], 8: [(-3, 0)], 9: [(4, 4)], 10: [(0, 49)], 11: [(1, 1)]}
    own = by_page(m)
    starts = {k: [p for p in v if p in own.get(k, ())] for k, v in starts.items()}
    s = spark.createDataFrame([(k, *p) for k, v in starts.items() for p in v], "page int, y int, x int")
    got = by_page(tiles.geodesics(m, s, tile), "v")
    for page, pixels in own.items():
        want = heap_ways(pixels, starts[page])
        assert got.get(page, {}) == {p: pytest.approx(v) for p, v in want.items()}


def plain_clipped(own, clip):
    near = lambda p, s: [(p[0] + a, p[1] + b) for a, b in EIGHT if (p[0] + a, p[1] + b) in s]
    ends = sorted(p for p in own if len(near(p, own)) == 1)
    if len(own) < 3 or len(ends) < 2:
        return set(own)
    far = lambda s: (lambda w: min((p for p in ends if p in w), key=lambda p: (-round(w[p], 6), p)))(heap_ways(own, [s]))
    a = far(ends[0])
    b = far(a)
    va, vb = heap_ways(own, [a]), heap_ways(own, [b])
    left = {p for p in own if p in va and p in vb and round(va[p], 6) >= clip and round(vb[p], 6) >= clip}
    if not left:
        return set(own)
    parts = []
    rest = set(left)
    while rest:
        reach, part = [rest.pop()], set()
        while reach:
            p = reach.pop()
            part.add(p)
            for q in near(p, rest):
                rest.discard(q)
                reach.append(q)
        parts.append(part)
    return max(parts, key=lambda s: (len(s), [-v for v in min(s)]))


@pytest.mark.parametrize("tile,clip", [(8, 3.0), (64, 6.5), (64, 900.0)])
def test_endcaps(spark, tile, clip):
    rows = [(1, y, 10) for y in range(30)] + [(1, 15, x) for x in range(10, 25)] + [(1, 3, x) for x in range(5, 10)]
    rows += [(2, 0, x) for x in range(9)] + [(3, 1, 1), (3, 1, 2)] + [(4, y, x) for y in range(4) for x in range(4)] + [(5, 0, 0)]
    rows += [(6, 2 * k, 0) for k in range(5)] + [(6, 20, x) for x in range(20)] + [(6, 22, x) for x in range(5)]
    m = spark.createDataFrame(rows, "page int, y int, x int")
    got = {k: set(v) for k, v in by_page(tiles.endcaps_clipped(m, clip, tile)).items()}
    assert got == {k: plain_clipped(set(v), clip) for k, v in by_page(m).items()}


@tables
def test_endcaps_query(spark):
    got = {k: set(v) for k, v in by_page(QUERIES["endcaps_clipped"](spark, SF)).items()}
    skeleton = by_page(raster.skeleton(plans.ml(spark, SF).withColumn("page", F.col("page").cast("int"))))
    assert got == {k: plain_clipped(set(v), 3.0) for k, v in skeleton.items()}


def test_tiles_empty(spark):
    none = spark.createDataFrame([], "page int, y int, x int")
    for out in (tiles.distances(none), tiles.opening_residues(none, (4, 4)), tiles.thinned(none), tiles.medial_axis(none), tiles.disc_seeds(none, 3), tiles.geodesics(none, none), tiles.endcaps_clipped(none, 2.0), isolines.outline_tree(none, (4, 4))):
        assert out.count() == 0


# -- chains and isolines ------------------------------------------------------------------------


def test_ranked_chains(spark):
    steps = [(k, k + 1) for k in range(100, 1100)] + [(7, 3), (3, 9)] + [(50, 40), (40, 45), (45, 50)] + [(60, 60)] + [(2000 + k, 2000 + (k + 5) % 37) for k in range(37)]
    got = {r.node: (r.chain, r.i, r.closed) for r in isolines.ranked_chains(spark.createDataFrame(steps, "a long, b long")).collect()}
    want = {k: (100, k - 100, False) for k in range(100, 1101)} | {7: (7, 0, False), 3: (7, 1, False), 9: (7, 2, False)}
    want |= {40: (40, 0, True), 45: (40, 1, True), 50: (40, 2, True), 60: (60, 0, True)}
    want |= {2000 + (5 * k) % 37: (2000, k, True) for k in range(37)}
    assert got == want
    assert isolines.ranked_chains(spark.createDataFrame([], "a long, b long")).count() == 0


def test_isolines_of_a_cone(spark):
    n = 41
    rows = [(page, y, x, math.hypot(y - 20, x - 20 - 3 * page) if (y, x) != (0, 0) else bad) for page, bad in ((0, math.nan), (1, None), (2, math.inf)) for y in range(n) for x in range(n)]
    lines = isolines.isolines(spark.createDataFrame(rows, "page int, y int, x int, v double"), 12.5).collect()
    for page in (0, 1, 2):
        own = sorted((r for r in lines if r.page == page), key=lambda r: r.i)
        assert len({r.line for r in own}) == 1 and all(r.closed for r in own) and [r.i for r in own] == list(range(len(own)))
        assert (own[0].y, own[0].x) == (own[-1].y, own[-1].x)
        assert all(abs(math.hypot(r.y - 20, r.x - 20 - 3 * page) - 12.5) < 0.02 for r in own)
        length = sum(math.hypot(a.y - b.y, a.x - b.x) for a, b in zip(own, own[1:]))
        assert abs(length - 25 * math.pi) < 0.3
        area = sum(a.x * b.y - b.x * a.y for a, b in zip(own, own[1:])) / 2
        assert abs(abs(area) - math.pi * 12.5**2) < 5


def test_saddles_and_open_lines(spark):
    rows = [(0, y, x, float((y + x) % 2)) for y in range(3) for x in range(3)] + [(1, y, x, float(x)) for y in range(4) for x in range(3)]
    lines = isolines.isolines(spark.createDataFrame(rows, "page int, y int, x int, v double"), 0.5).collect()
    first = [r for r in lines if r.page == 0]
    assert len({r.line for r in first}) == 4 and not any(r.closed for r in first)  # each of the four high pixels at the border by itself
    second = sorted((r for r in lines if r.page == 1), key=lambda r: r.i)
    assert [(r.y, r.x, r.closed) for r in second] in ([(float(y), 0.5, False) for y in range(4)], [(float(3 - y), 0.5, False) for y in range(4)])


def plain_side_arc(loop, centre, middle, side, lookahead, reach, lock):
    loop, centre = np.array(loop, float), np.array(centre, float)  # y, x
    k = max(1, min(lookahead, len(centre) - 1))

    def target(p, t):
        n = np.array([-t[1], t[0]])
        n = n / max(np.linalg.norm(n), 1e-30) if np.linalg.norm(n) >= 1e-9 else n * 0
        u = n if n @ (middle - p) >= -n @ (middle - p) else -n
        return p + (u if side == "inner" else -u) * reach

    ends = target(centre[0], centre[k] - centre[0]), target(centre[-1], centre[-1] - centre[-1 - k])
    i0, i1 = (int(np.argmin(((loop - t) ** 2).sum(1))) for t in ends)
    if i0 <= i1:
        a, b = loop[i0 : i1 + 1], np.vstack([loop[i1:], loop[: i0 + 1]])
    else:
        a, b = np.vstack([loop[i0:], loop[: i1 + 1]]), loop[i1 : i0 + 1]
    ra, rb = (np.linalg.norm(q - middle, axis=1).mean() for q in (a, b))
    line = (a if ra <= rb else b) if side == "inner" else (a if ra >= rb else b)
    d = lambda p, q: np.linalg.norm(p - q)
    if d(line[-1], centre[0]) + d(line[0], centre[-1]) < d(line[0], centre[0]) + d(line[-1], centre[-1]):
        line = line[::-1]
    if lock:
        line = line + [(centre[0, 0] + centre[-1, 0]) / 2 - (line[0, 0] + line[-1, 0]) / 2, 0]
    return line


@pytest.mark.parametrize("side,lock", [("inner", False), ("outer", True)])
def test_side_arcs(spark, side, lock):
    r = random.Random(5)
    loops, centres, want = [], [], {}
    for page in range(6):
        turn = r.random() * 6
        ring = [(20 + 12 * math.sin(turn + t / 30 * 6.2832) + r.random(), 20 + 9 * math.cos(turn + t / 30 * 6.2832)) for t in range(30)]
        ring.append(ring[0])
        way = [(20 + 10 * math.sin(0.1 * t + page), 20 + 8 * math.cos(0.1 * t + page)) for t in range(26)]
        loops += [(page, i, *p) for i, p in enumerate(ring)]
        centres += [(page, i, x, y) for i, (y, x) in enumerate(way)]
        want[page] = ring, way
    c = spark.createDataFrame(centres, "page int, i int, x double, y double")
    middles = {r.page: (r.cy, r.cx) for r in isolines.curves.origins(c, 80, 5, 10, "page").collect()}
    got = isolines.side_arcs(spark.createDataFrame(loops, "page int, i int, y double, x double"), c, side, 7, 50.0, lock, 5).collect()
    for page, (ring, way) in want.items():
        own = sorted((r.i, r.y, r.x) for r in got if r.page == page)
        line = plain_side_arc(ring, way, np.array(middles[page]), side, 7, 50.0, lock)
        assert [i for i, *_ in own] == list(range(len(line)))
        assert np.allclose([p[1:] for p in own], line)


@tables
def test_side_arc_query(spark):
    got = defaultdict(list)
    for r in QUERIES["offset_side_lines"](spark, SF).collect():
        got[r.page].append((r.i, r.y, r.x))
    field = tiles.distances(plans.corridor(spark, SF))
    framed = plans.pl(spark, SF).select("page", "y", "x").join(field, ["page", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    loops = defaultdict(list)
    for r in sorted(isolines.longest_lines(isolines.isolines(framed, 1.5)).collect(), key=lambda r: r.i):
        loops[r.page].append((r.y, r.x))
    centre = plans.centres(spark, SF).select("page", "i", "x", "y")
    middles = {r.page: (r.cy, r.cx) for r in isolines.curves.origins(centre, 4, 2, 10, "page").collect()}
    way = [(2.0 + 3 * i, 12 + (2 + 3 * i) / 4) for i in range(10)]
    for page, loop in loops.items():
        line = plain_side_arc(loop, way, np.array(middles[page]), "outer", 3, 20.0, False)
        assert np.allclose([p[1:] for p in sorted(got[page])], line, atol=2e-6), page
    assert set(got) == set(loops)


def test_outline_tree(spark):
    box = lambda a, b: {(y, x) for y in range(a, b) for x in range(a, b)}
    nested = (box(1, 15) - box(3, 13)) | (box(5, 11) - box(6, 10)) | {(7, 7), (8, 8)}
    m = spark.createDataFrame([(0, *p) for p in nested] + [(1, 0, 0), (1, 0, 1)], "page int, y int, x int")
    rows = isolines.outline_tree(m, (16, 16)).collect()
    at = lambda r: (r.page, r.outline % 10**12 // 10**6, r.outline % 10**6)
    name = {r.outline: at(r) for r in rows}
    got = {at(r): (r.hole, name.get(r.parent), r.depth, r.pixels) for r in rows}
    assert got == {
        (0, 1, 1): (False, None, 0, 96), (0, 3, 3): (True, (0, 1, 1), 1, 64), (0, 5, 5): (False, (0, 3, 3), 2, 20),
        (0, 6, 6): (True, (0, 5, 5), 3, 14), (0, 7, 7): (False, (0, 6, 6), 4, 2), (1, 0, 0): (False, None, 0, 2),
    }


# -- boundaries -----------------------------------------------------------------------------------


def plain_march(own, y, x, dy, dx, step, most):
    k = 0
    while k < most / step and (round(y + dy * (k + 1) * step), round(x + dx * (k + 1) * step)) in own:
        k += 1
    return k * step if k else None


def plain_sides(own, way, size, spacing, most, span=3, guard=2, step=0.5, smooth=0.6, bias=0.01, ray=0.5, neighbours=6, window=3):
    box = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    inside = lambda p: 0 <= p[0] < size[0] and 0 <= p[1] < size[1]
    wide = {q for p in own for a, b in box if inside(q := (p[0] + a, p[1] + b))}
    core = {p for p in own if all((p[0] + a, p[1] + b) in own for a, b in box if inside((p[0] + a, p[1] + b)))}
    rim = wide - core
    gap = {p: min((math.hypot(p[0] - a, p[1] - b) for a, b in rim), default=1e6) for p in wide}
    way = np.array(way, float)  # y, x
    cum = np.r_[0, np.cumsum(np.linalg.norm(np.diff(way, axis=0), axis=1))]
    at = [*np.arange(0, cum[-1] - 1e-9, spacing)]
    at += [cum[-1]] if cum[-1] - at[-1] > 1e-6 else []
    p = np.stack([np.interp(at, cum, way[:, k]) for k in (0, 1)], 1)
    n = len(p)
    t = np.array([p[min(n - 1, i + span)] - p[max(0, i - span)] for i in range(n)])
    g = min(guard, (n - 1) // 2)
    t = np.array([t[g] if i < g else t[n - 1 - g] if i > n - 1 - g else t[i] for i in range(n)])
    t /= np.linalg.norm(t, axis=1)[:, None]

    def field(y, x):
        a, b = math.floor(y), math.floor(x)
        total = 0.0
        for u, v in ((0, 0), (0, 1), (1, 0), (1, 1)):
            share = abs(1 - u - (y - a)) * abs(1 - v - (x - b))
            if share > 0:
                if (a + u, b + v) not in gap:
                    return 1e6
                total += share * gap[a + u, b + v]
        return total

    out = {}
    for side in (1, -1):
        line, before = [], 0.0
        for q, (ty, tx) in zip(p, t):
            dy, dx = tx * side, -ty * side
            cap = plain_march(own, *q, dy, dx, ray, most + ray)
            if cap is None:
                line.append(q)
                continue
            ds = [k * step for k in range(math.floor(most / step + 1e-9) + 1) if k * step <= cap]
            before = min(ds, key=lambda d: (field(q[0] + dy * d, q[1] + dx * d) + smooth * abs(d - before) + bias * d, d))  # noqa: B023
            line.append(q + np.array([dy, dx]) * before)
        line = np.array(line)
        k = max(2, min(neighbours, n - 2))
        if n >= 4:
            done = line.copy()
            for i, near in ((0, slice(1, 1 + k)), (n - 1, slice(n - 1 - k, n - 1))):
                v = line[near] - p[near]
                v = v[np.linalg.norm(v, axis=1) >= 1e-9]
                m = (v / np.linalg.norm(v, axis=1)[:, None]).sum(0) if len(v) else np.zeros(2)
                if np.linalg.norm(m) >= 1e-9:
                    m /= np.linalg.norm(m)
                    d = plain_march(own, *p[i], *m, ray, math.hypot(*size))
                    if d is not None:
                        done[i] = p[i] + m * d
            line = done
        if n >= max(3, window):
            pad = np.pad(line, ((window // 2, window // 2), (0, 0)), "edge")
            line = np.stack([np.convolve(pad[:, k], np.ones(window) / window, "valid") for k in (0, 1)], 1)
        for i in range(1, n):
            s = p[i] - p[i - 1]
            if np.linalg.norm(s) >= 1e-9:
                u = s / np.linalg.norm(s)
                ahead = (line[i] - line[i - 1]) @ u
                if ahead < 0:
                    line[i] = line[i] + (1e-6 - ahead) * u
        out[side] = line
    return out


@tables
def test_fitted_sides_query(spark):
    got = defaultdict(list)
    for r in QUERIES["fitted_sides"](spark, SF).collect():
        got[r.path_id, r.side].append((r.i, r.y, r.x))
    masks = by_page(plans.corridor(spark, SF))
    way = [(2.0 + 3 * i, 12 + (2 + 3 * i) / 4) for i in range(10)]
    worse = 0
    for page, own in masks.items():
        for side, line in plain_sides(set(own), way, plans.SIZE, 2.0, 12.0).items():
            mine = np.array([p[1:] for p in sorted(got[page, side])])
            assert mine.shape == line.shape
            worse += not np.allclose(mine, line, atol=1e-3)
    assert worse == 0 and len(got) == 2 * len(masks)


def test_fitted_sides_of_a_straight_band(spark):
    m = spark.createDataFrame([(1, y, x) for y in range(40) for x in range(8, 25)], "page int, y int, x int")
    c = spark.createDataFrame([(5, 0, 1, 16.0, 3.0), (5, 1, 1, 16.0, 36.0)], "path_id long, i int, page int, x double, y double")
    got = boundary.fitted_sides(c, m, (40, 40), 3.0, 20.0).collect()
    assert all(abs(r.x - {1: 8, -1: 24}[r.side]) <= 1 for r in got) and len(got) == 2 * 12


def plain_widths(own, black, points, size, most, step, grace):
    """One path: snapped points (x, y) and raw ones (rx, ry)."""

    def boundary_at(x, y, dx, dy):
        t, out_t, out_trigger = step, None, None
        seen_out = None
        while t <= most:
            px, py = round(x + dx * t), round(y + dy * t)
            if not (0 <= px < size[1] and 0 <= py < size[0]):
                return t
            if (py, px) in black:
                return t
            if (py, px) not in own:
                seen_out = t if seen_out is None else seen_out
                out_trigger = seen_out if out_trigger is None else out_trigger
            else:
                seen_out = None
            if out_trigger is not None and t >= out_trigger + grace:
                return out_trigger
            t += step
        return out_trigger

    rows = []
    n = len(points)
    for i, (x, y, rx, ry) in enumerate(points):
        a, b = points[max(0, i - 1)], points[min(n - 1, i + 1)]
        tx, ty = b[2] - a[2], b[3] - a[3]
        norm = math.hypot(tx, ty)
        if (round(y), round(x)) not in own:
            rows.append([x, y, None, None, None, "center_not_on_support", False])
        elif norm < 1e-6:
            rows.append([x, y, None, None, None, "zero_tangent", False])
        else:
            nx, ny = -ty / norm, tx / norm
            p, q = boundary_at(x, y, nx, ny), boundary_at(x, y, -nx, -ny)
            rows.append([x, y, p, q, p + q if p is not None and q is not None else None, None, False])
    return rows


def plain_rescue(rows, own, black, size, most, step, low=0.5, extra_sigma=1.0, ratio=0.6):
    vals = [r[4] for r in rows if r[4] is not None]
    if len(vals) > 5:
        med, sd = float(np.median(vals)), float(np.std(vals))
        extra, n = max(step, extra_sigma * sd), len(rows)
        for i, r in enumerate(rows):
            if r[4] is None or r[4] >= med - low * sd:
                continue
            a, b = rows[max(0, i - 1)], rows[min(n - 1, i + 1)]
            tx, ty = b[0] - a[0], b[1] - a[1]
            norm = math.hypot(tx, ty)
            if norm < 1e-6:
                continue
            new = []
            for d, sign in ((r[2], 1), (r[3], -1)):
                dx, dy = -ty / norm * sign, tx / norm * sign
                t0, t1 = d + step, min(most, d + extra)
                if t1 > t0:
                    seen, t = [], max(step, t0)
                    while t <= t1:
                        p = round(r[1] + dy * t), round(r[0] + dx * t)
                        seen.append((t, p, 0 <= p[0] < size[0] and 0 <= p[1] < size[1]))
                        t += step
                    inner = [p in own and p not in black for _, p, ok in seen if ok]
                    if inner and sum(inner) / len(inner) >= ratio:
                        hit = next((t for t, p, ok in seen if not ok or p in black or p not in own), None)
                        d = t1 if hit is None else max(d, hit)
                new.append(d)
            if sum(new) > r[4] + 1e-6:
                r[2], r[3], r[4], r[6] = *new, sum(new), True
    return rows


@tables
@pytest.mark.parametrize("low,extra", [(0.5, 1.0), (-0.5, 3.0)])
def test_rescued_widths(spark, low, extra):
    masks, black = by_page(plans.corridor(spark, SF)), by_page(plans.pl(spark, SF).where("v > 0.2"))
    held, dark = plans.corridor(spark, SF), plans.pl(spark, SF).where("v > 0.2").select("page", "y", "x")
    points = defaultdict(list)
    for r in sorted(plans.snapped_centres(spark, SF).collect(), key=lambda r: r.i):
        points[r.path_id].append((r.x, r.y, r.rx, r.ry))
    w = boundary.station_widths(plans.snapped_centres(spark, SF), held, dark, plans.SIZE, 14.0, grace=4.0)
    got = defaultdict(list)
    for r in sorted(boundary.rescued_widths(w, held, dark, plans.SIZE, 14.0, low_sigma=low, extra_sigma=extra).collect(), key=lambda r: r.i):
        got[r.path_id].append([r.x, r.y, r.d_pos, r.d_neg, r.w, r.reason, r.rescued])
    grew = 0
    for page, own in points.items():
        first = plain_widths(set(masks[page]), set(black.get(page, ())), own, plans.SIZE, 14.0, 1.0, 4.0)
        want = plain_rescue(first, set(masks[page]), set(black.get(page, ())), plans.SIZE, 14.0, 1.0, low, extra)
        assert len(got[page]) == len(want)
        for a, b in zip(got[page], want):
            assert all(p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) < 1e-9 for p, q in zip(a, b)), (page, a, b)
        grew += sum(r[6] for r in want)
    assert grew


def test_rescue_in_rounds_ends(spark):
    own = [(0, y, x) for y in range(30) for x in range(4, 26)]
    dark = [(0, y, x) for y in range(10, 13) for x in (17, 19, 21)]
    pts = [(1, k, 0, 15.0, float(2 + 2 * k)) for k in range(13)]
    held, black = (spark.createDataFrame(r, "page int, y int, x int") for r in (own, dark))
    w = boundary.station_widths(spark.createDataFrame(pts, "path_id int, i int, page int, x double, y double"), held, black, (30, 30), 14.0, grace=2.0)
    once = boundary.rescued_widths(w, held, black, (30, 30), 14.0, ratio=0.3)
    more = boundary.rescued_widths(w, held, black, (30, 30), 14.0, ratio=0.3, rounds=6)
    assert once.count() == more.count() == 13
    total = lambda df: df.agg(F.sum("w")).first()[0]
    assert total(w) < total(once) <= total(more)
    assert stats.without_high_widths(more).count() == 13
