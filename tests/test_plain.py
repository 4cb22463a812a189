"""Queries without SQL against plain versions, over whole driver tables."""

import math
import os
from collections import defaultdict

import numpy as np
import pytest

from kerbflow.operators import graph, stats, tiles
from kerbflow.plans import more, pixels
from kerbflow.plans import queries as plans
from kerbflow.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def grouped(df, key, *columns):
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append(tuple(r[c] for c in columns))
    return out


def test_skeleton_query(spark):
    got = grouped(QUERIES["skeleton"](spark, SF), "page", "y", "x")
    around = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    for page, own in grouped(plans.mask(spark, SF), "page", "y", "x").items():
        left = set(own)
        while True:
            before = set(left)
            for north in (True, False):
                gone = set()
                for y, x in left:
                    p = [(y + a, x + b) in left for a, b in around]
                    n, e, s, w = p[0], p[2], p[4], p[6]
                    turns = sum(not p[k - 1] and p[k] for k in range(8))
                    free = not (n and e and s) and not (e and s and w) if north else not (n and e and w) and not (n and s and w)
                    if 2 <= sum(p) <= 6 and turns == 1 and free:
                        gone.add((y, x))
                left -= gone
            if left == before:
                break
        assert set(got[page]) == left


def test_outlines_query(spark):
    got = grouped(QUERIES["outlines"](spark, SF), "component", "i", "y", "x")
    parts = grouped(more._labelled(plans.px(spark, SF).where("v > 0.02")), "component", "y", "x")
    assert set(got) == set(parts)
    for name, own in parts.items():
        own = set(own)
        walk = [(y, x) for _, y, x in sorted(got[name])]
        outside, reach = {(-1, -1)}, [(-1, -1)]
        while reach:
            y, x = reach.pop()
            for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if q not in own and q not in outside and -1 <= q[0] <= 8 and -1 <= q[1] <= 8:
                    outside.add(q)
                    reach.append(q)
        border = {(y, x) for y, x in own if {(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)} & outside}
        assert walk[0] == min(own) and set(walk) == border
        assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(walk, walk[1:] + walk[:1])) or len(walk) == 1


def test_simplified_query(spark):
    got = grouped(QUERIES["polygon_simplify"](spark, SF), "path_id", "i", "x", "y")
    for path, rows in grouped(plans.pt(spark, SF), "path_id", "i", "x", "y").items():
        p = [np.array(r[1:], float) for r in sorted(rows)]
        ring = [*p, p[0]]
        least = 0.01 * sum(np.linalg.norm(a - b) for a, b in zip(ring, ring[1:]))

        def gap(q, a, b):
            d = b - a
            return np.linalg.norm(q - a) if np.linalg.norm(d) < 1e-12 else abs(d[0] * (q - a)[1] - d[1] * (q - a)[0]) / np.linalg.norm(d)

        def thin(a, b):
            gaps = [(gap(ring[k], ring[a], ring[b]), -k) for k in range(a + 1, b)]  # noqa: B023
            if not gaps or max(gaps)[0] <= least:  # noqa: B023
                return [a]
            k = -max(gaps)[1]
            return thin(a, k) + thin(k, b)  # noqa: B023

        far = max(range(len(p)), key=lambda k: (np.linalg.norm(p[k] - p[0]), -k))
        want = [ring[k] for k in ([0] if far == 0 else thin(0, far)) + thin(far, len(p)) if k or far]
        assert np.allclose([r[1:] for r in sorted(got[path])], want, atol=1e-4)


def neighbours(rows):
    near = defaultdict(dict)
    for a, b, *c in rows:
        near[a][b] = near[b][a] = c[0] if c else 1
    return near


def test_branches_query(spark):
    got = grouped(QUERIES["branches_pruned"](spark, SF), "page", "a", "b")
    for page, rows in grouped(plans.page_edges(spark, SF), "page", "a", "b").items():
        near = neighbours(rows)
        while True:
            short = []
            for v in near:
                if len(near[v]) == 1:
                    walk, before = [v], None
                    while len(near[walk[-1]]) <= 2:
                        on = [q for q in near[walk[-1]] if q != before and q not in walk[-2:]]
                        if not on:
                            break
                        before = walk[-1]
                        walk.append(min(on))
                    if len(near[walk[-1]]) > 2 and len(walk) <= 3:
                        short.append((len(walk), walk))
            if not short:
                break
            walk = min(short)[1]
            for a, b in zip(walk, walk[1:]):
                del near[a][b], near[b][a]
        assert sorted(got[page]) == sorted((a, b) for a, b in rows if b in near[a])


def lengths(near, start):
    best = {start: 0.0}
    while True:  # until nothing improves
        new = {q: min(best[v] + c for v, c in near[q].items() if v in best) for q in near if any(v in best for v in near[q])}
        better = {q: d for q, d in new.items() if d < best.get(q, math.inf) - 1e-12}
        if not better:
            return best
        best |= better


def test_main_path_clipped_query(spark):
    got = grouped(QUERIES["ends_clipped"](spark, SF), "page", "node", "distance")
    for page, rows in grouped(plans.page_edges(spark, SF), "page", "a", "b", "cost").items():
        near = neighbours(rows)
        far = lambda d: min(d, key=lambda v: (-round(d[v], 9), v))
        one = far(lengths(near, min(near)))
        way = lengths(near, one)
        total = max(way.values())
        for node, d in got[page]:
            assert abs(way[node] - d) < 1e-3 and 2 - 1e-4 <= d <= total - 2 + 1e-4
        if total >= 4:
            assert {d for _, d in got[page]} == {d for _, d in got[page]} and len(got[page]) == len({n for n, _ in got[page]})


@pytest.mark.parametrize("guided", [True, False])
def test_grid_paths(spark, guided):
    p = pixels.pl(spark, SF)
    costs = p.selectExpr("cast(page as int) page", "y", "x", "cast(case when v > 0.1 then 8.0 when v > -0.05 then 1.2 else 0.35 end as double) as cost").where("(y * 3 + x * 5) % 17 > 0")
    ends = costs.groupBy("page").agg({"page": "count"}).selectExpr("page", "1 as ay", "1 as ax", "6 as by", "29 as bx")
    got = grouped(graph.grid_paths(costs, ends, guided), "page", "i", "y", "x", "distance")
    for page, rows in grouped(costs, "page", "y", "x", "cost").items():
        cost = {(y, x): c for y, x, c in rows}
        ahead = lambda q: math.hypot(q[0] - 6, q[1] - 29) if guided else 0.0
        best, before, waiting, done = {(1, 1): 0.0}, {}, [(ahead((1, 1)), (1, 1))], set()
        while waiting:
            first = min(waiting)
            waiting.remove(first)
            v = first[1]
            if v in done:
                continue
            done.add(v)
            if v == (6, 29):
                break
            for a, b in EIGHT:
                q = (v[0] + a, v[1] + b)
                if q in cost and q not in done:
                    d = best[v] + cost[q] * (1.4142 if a and b else 1.0)
                    if d < best.get(q, math.inf):
                        best[q], before[q] = float(np.float32(d)), v
                        waiting.append((d + ahead(q), q))
        if (6, 29) not in done:
            assert page not in got
            continue
        way = sorted(got[page])
        assert way[0][1:3] == (1, 1) and way[-1][1:3] == (6, 29) and abs(way[-1][3] - best[6, 29]) < 1e-3
        assert all(max(abs(p[1] - q[1]), abs(p[2] - q[2])) == 1 for p, q in zip(way, way[1:]))


# -- centrelines ------------------------------------------------------------------------------


def skeleton_ways(own, start):
    near = {p: {q: math.hypot(a, b) for a, b in EIGHT if (q := (p[0] + a, p[1] + b)) in own} for p in own}
    return lengths(near, start)


def checked(rows, skeleton, distance):
    rows = sorted(rows)
    way = [(y, x) for _, y, x, *_ in rows]
    best = skeleton_ways(skeleton, way[0])
    assert [r[0] for r in rows] == list(range(len(rows)))
    assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(way, way[1:]))
    assert all(abs(r[3] - best[r[1], r[2]]) < 1e-3 and abs(r[4] - distance[r[1], r[2]]) < 1e-3 for r in rows)
    return way, best


def test_centreline_queries(spark):
    mask = pixels.corridor(spark, SF)
    axis = grouped(tiles.medial_axis(mask, 64), "page", "y", "x", "v")
    clipped = grouped(tiles.endcaps_clipped(tiles.medial_axis(mask, 64), 3.0, 64), "page", "y", "x")
    got = grouped(QUERIES["centrelines"](spark, SF), "page", "i", "y", "x", "v", "distance")
    assert got
    for page, rows in got.items():
        own = set(clipped[page])
        way, best = checked(rows, own, {(y, x): v for y, x, v in axis[page]})
        ends = sorted(p for p in own if sum((p[0] + a, p[1] + b) in own for a, b in EIGHT) == 1)
        first = skeleton_ways(own, ends[0])
        a = min((p for p in ends if p in first), key=lambda p: (-round(first[p], 6), p))
        b = min((p for p in ends if p in best), key=lambda p: (-round(best[p], 6), p))
        assert (way[0], way[-1]) == (a, b)
    trimmed = grouped(QUERIES["centrelines_top_bottom"](spark, SF), "page", "i", "y", "x", "v", "distance")
    whole = grouped(tiles.centrelines(mask, 0.0, tiles.TOP_BOTTOM, 64), "page", "i", "y", "x", "v", "distance")
    masks = grouped(mask, "page", "y", "x")
    for page, rows in whole.items():
        own = {(y, x) for y, x, _ in axis[page]}
        way, _ = checked(rows, own, {(y, x): v for y, x, v in axis[page]})
        for end, row in ((way[0], min(masks[page])[0]), (way[-1], max(masks[page])[0])):
            xs = [x for y, x in masks[page] if y == row]
            assert end == min(own, key=lambda p: ((p[0] - row) ** 2 + (p[1] - (min(xs) + max(xs)) / 2) ** 2, p))  # noqa: B023
        rows = sorted(rows)
        head, tail, total = rows[0][4], rows[-1][4], rows[-1][3]
        want = [(r[1], r[2]) for r in rows if r[3] >= head and total - r[3] >= tail]
        assert [(y, x) for _, y, x, *_ in sorted(trimmed.get(page, []))] == want
    with pytest.raises(ValueError, match="unknown strategy"):
        tiles.centrelines(mask, 0.0, "other", 64)


def test_area_models_drop_widths_of_nothing(spark):
    rows = [(1, i, 2.0, w) for i, w in enumerate([4.0, 5.0, 0.0, 6.0, -3.0, 5.5, 4.5])]
    none = [(1, i, n, w if w > 0 else None) for _, i, n, w in rows]
    a, b = (spark.createDataFrame(r, "path_id int, i int, len double, w double") for r in (rows, none))
    for model in (stats.area_model_1, stats.area_model_2, stats.area_model_3):
        assert model(a).collect() == model(b).collect()
