"""Whole pages, squares and paths that share a task, against the cut forms and plain versions."""

import math
import random
from collections import defaultdict

import pytest

from kerbflow.operators import graph, isolines, raster, shapes, tiles
from tests.test_pixels import blobs, by_page, heap_ways, plain_axis


def test_cut_pages_thinned(spark, monkeypatch):
    monkeypatch.setattr(tiles, "WHOLE", 100)  # the page of one row of 50 is whole, two others are cut
    m = blobs(spark, 1, share=0.93)
    assert by_page(tiles.thinned(m, 13, 4)) == by_page(raster.skeleton(m))


def test_cut_pages_axis_seeds_and_ways(spark, monkeypatch):
    monkeypatch.setattr(tiles, "WHOLE", 0)
    tile, m = 16, blobs(spark, 2, share=0.95)
    own = by_page(m)
    assert by_page(tiles.medial_axis(m, tile), "v") == {page: {p: pytest.approx(v) for p, v in plain_axis(set(q)).items()} for page, q in own.items()}
    seeds = sorted((r.page, r.seed, r.y, r.x) for r in graph.greedy_seeds(m.distinct(), 4).collect())
    assert sorted(tuple(r) for r in tiles.disc_seeds(m, 4, tile).collect()) == seeds
    starts = {page: [min(q)] for page, q in own.items()}
    got = by_page(tiles.geodesics(m, spark.createDataFrame([(k, *p) for k, v in starts.items() for p in v], "page int, y int, x int"), tile), "v")
    assert all(got[page] == {p: pytest.approx(v) for p, v in heap_ways(q, starts[page]).items()} for page, q in own.items())


def test_pages_share_a_canvas(spark, monkeypatch):
    monkeypatch.setattr(tiles, "CANVAS", 300)
    r = random.Random(5)
    rows = [(page, y + page * 3, x - page) for page in range(-9, 30) for y in range(3 + page % 7) for x in range(2 + page % 11) if r.random() < 0.9]
    m = spark.createDataFrame(rows, "page int, y int, x int")
    assert by_page(tiles.medial_axis(m, 4), "v") == {page: {p: pytest.approx(v) for p, v in plain_axis(set(q)).items()} for page, q in by_page(m).items()}


def test_small_pages_need_no_rounds(spark, monkeypatch):
    """Each round is a checkpoint and some jobs, whatever is in it."""
    rounds = []
    plain = tiles.until_stable
    monkeypatch.setattr(tiles, "until_stable", lambda *a, **k: (lambda out: rounds.append(out[1]) or out)(plain(*a, **k)))
    m = blobs(spark, 2, share=0.95)
    tiles.medial_axis(m, 7), tiles.thinned(m, 8, 1), tiles.geodesics(m, m.limit(1), 6)
    assert rounds == [1, 1, 1]


def test_cut_and_whole_pages_have_the_same_centrelines(spark, monkeypatch):
    """Pages that fit a task go through it whole, the others by tiles; both choose the same pixels."""
    m = blobs(spark, 3, share=0.97)
    kinds = [lambda: tiles.centrelines(m, 2.0, tile=32)]
    rows = lambda df: sorted(tuple(round(c, 4) if isinstance(c, float) else c for c in r) for r in df.collect())
    whole = [rows(k()) for k in kinds]
    monkeypatch.setattr(tiles, "WHOLE", 300)
    assert all(whole) and [rows(k()) for k in kinds] == whole


def test_centrelines_of_small_pages_take_few_tables(spark, monkeypatch):
    """Each sweep over a page had been a table of its own, and each doubling of the way's pointers three more."""
    made = []
    monkeypatch.setattr(tiles, "checkpointed", lambda df: made.append(df) or graph.checkpointed(df))
    m = spark.createDataFrame([(page, y, x) for page in range(3) for y in range(20) for x in range(6 + page)], "page int, y int, x int")
    assert tiles.centrelines(m, 2.0, tile=8).count() > 0 and len(made) <= 8


def plain_parts(own, near):
    left, out = set(own), {}
    while left:
        reach = [min(left)]
        left.discard(reach[0])
        part = set(reach)
        while reach:
            y, x = reach.pop()
            for q in {(y + a, x + b) for a, b in near} & left:
                left.discard(q)
                part.add(q)
                reach.append(q)
        out |= dict.fromkeys(part, min(part))
    return out


@pytest.mark.parametrize("square", [8, 512])
@pytest.mark.parametrize("neighbours", [4, 8])
def test_components_over_squares(spark, monkeypatch, square, neighbours):
    monkeypatch.setattr(graph, "SQUARE", square)
    m = blobs(spark, 4, share=0.6)
    near = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if neighbours == 8 else [])
    got = by_page(graph.labelled(m, neighbours), "component")
    for page, own in by_page(m).items():
        assert got[page] == {p: q[0] * 1_000_000 + q[1] + page * 1_000_000_000_000 for p, q in plain_parts(own, near).items()}


def test_components_within_a_square_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "star_components", None)
    m = spark.createDataFrame([(page, y, x) for page in range(5) for y in range(20) for x in range(20) if (x + y * page) % 3], "page int, y int, x int")
    assert graph.labelled(m).count() == m.count()
    assert isolines.outline_tree(m, (20, 20)).count() > 5
    assert raster.largest_filled(m, 1, (20, 20)).count() >= m.count() / 2


def grouped_calls(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_many_groups_share_a_call(spark):
    """One call a group cost a millisecond or more; outlines, offsets and scales do many groups a call."""
    p = spark.createDataFrame([(k, 0, x, 0.5, k % 2 == 0) for k in range(4) for x in range(3)], "page long, y int, x int, v double, inside boolean")
    outlines = raster.contours(p.select("page", "page", "y", "x").toDF("page", "component", "y", "x"))
    offsets = graph.offset_fit(p.selectExpr("page as path_id", "x as i", "1.0 as cap", "0.5 as offset", "v as cost"))
    scales = graph.scale_search(p.selectExpr("page", "x as i", "double(x) x", "double(y) y"), p, p.selectExpr("page", "1.0 as cx", "0.0 as cy").distinct(), rounds=0)
    for df, call in ((outlines, "FlatMapGroupsInPandas"), (offsets, "FlatMapGroupsInPandas"), (scales, "FlatMapCoGroupsInPandas")):
        line = next(r for r in grouped_calls(df).splitlines() if call in r)
        assert "share#" in line.split("], run(")[0]
    assert outlines.count() == 16 and offsets.count() == 12 and scales.count() == 4


def plain_offsets(rows, smooth=0.6, bias=0.01):
    before, out = 0.0, {}
    by = defaultdict(list)
    for i, cap, d, cost in rows:
        by[i].append((d, cap, cost))
    for i in sorted(by):
        cap = by[i][0][1]
        if cap is None:
            out[i] = None
            continue
        fit = [(cost + smooth * abs(d - before) + bias * d, d) for d, _, cost in by[i] if d <= cap]
        before = min(fit)[1] if cap > 1e-9 and fit else 0.0
        out[i] = before
    return out


def test_offsets_of_paths_of_all_lengths(spark):
    r = random.Random(3)
    paths = {}
    for path in range(40):
        rows = paths[path] = []
        for i in range(r.randrange(1, 12)):
            cap = r.choice([None, 0.0, 1.2, 5.0])
            rows += [(i * 3, cap, 0.5 * k, r.random()) for k in range(r.randrange(1, 7))]
    every = [(f"p{k}", *row) for k, rows in paths.items() for row in rows]
    r.shuffle(every)
    got = defaultdict(dict)
    for row in graph.offset_fit(spark.createDataFrame(every, "path_id string, i long, cap double, offset double, cost double")).collect():
        got[row.path_id][row.i] = row.offset
    assert got == {f"p{k}": plain_offsets(rows) for k, rows in paths.items()}


def test_side_arcs_read_each_table_once(spark):
    """Copies of the loops' plan had doubled with each step, and with them the joins of one plan."""
    loops = [(page, i, float(i % 7), float(i)) for page in range(3) for i in range(20)]
    centre = [(page, i, float(i), 2.0) for page in range(3) for i in range(12)]
    loops, centre = spark.createDataFrame(loops, "page long, i long, y double, x double"), spark.createDataFrame(centre, "page long, i long, x double, y double")
    out = isolines.side_arcs(loops, centre, "outer", 3, 20.0, bend=2, span=4)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 2
    assert out.count() > 0


def plain_rectangle(points):
    """The least area of a rectangle along two of the points that holds all of them; the rectangle lies on a side of the hull, which is among these."""
    best = 0.0 if len(points) == 1 else None
    for (ay, ax), (by, bx) in ((p, q) for p in points for q in points if p < q):
        size = math.hypot(bx - ax, by - ay)
        u, v = (bx - ax) / size, (by - ay) / size
        s, t = ([x * u + y * v for y, x in points], [y * u - x * v for y, x in points])
        area = (max(s) - min(s)) * (max(t) - min(t))
        best = area if best is None else min(best, area)
    return best


def test_rectangles_of_many_groups_share_a_call(spark):
    """One call a group cost three milliseconds, which at 6 GB is hours of a core."""
    r = random.Random(8)
    groups = {k * 10**15 + 7: {(r.randrange(-w, w), r.randrange(-w, w)) for _ in range(r.randrange(1, 25))} for k in range(80) for w in [r.choice([1, 2, 4, 12])]}
    groups |= {None: {(0, 0), (3, 1), (1, 5)}, 2**62 + 1: {(2, 2)}, -5: {(4, x) for x in range(6)}}
    rows = [(k, *p) for k, own in groups.items() for p in own]
    out = shapes.smallest_rectangles(spark.createDataFrame([*rows, *rows[:50]], "component long, y int, x int"), "component")
    line = next(z for z in grouped_calls(out).splitlines() if "FlatMapGroupsIn" in z)
    assert "share#" in line.split("], run(")[0]
    got = defaultdict(list)
    for row in out.collect():
        got[row.component].append(row)
    assert set(got) == set(groups)
    for k, own in groups.items():
        corners = [(c.x, c.y) for c in sorted(got[k], key=lambda c: c.i)]
        (ax, ay), (bx, by), (cx, cy), (dx, dy) = corners
        assert len(corners) == 4 and got[k][0].area == pytest.approx(plain_rectangle(own), abs=1e-9)
        # a rectangle of that area, whose sides hold all points
        assert (ax + cx, ay + cy) == pytest.approx((bx + dx, by + dy), abs=1e-9) and (bx - ax) * (cx - bx) + (by - ay) * (cy - by) == pytest.approx(0, abs=1e-9)
        assert math.hypot(bx - ax, by - ay) * math.hypot(cx - bx, cy - by) == pytest.approx(got[k][0].area, abs=1e-6)
        for (px, py), (qx, qy) in zip(corners, [*corners[1:], corners[0]]):
            assert all((qx - px) * (y - py) - (qy - py) * (x - px) >= -1e-9 for y, x in own)
