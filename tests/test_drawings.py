"""Operators on drawings against plain step-by-step versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kerbflow.operators import curves, graph, items, labels, raster, shapes, spatial, stats


def test_nearest_in_crowds(spark, monkeypatch):
    monkeypatch.setattr(spatial, "LEAF", 4)
    r = random.Random(7)
    crowd = [(1, k, 500 + r.random() * 0.01, 500 + r.random() * 0.01) for k in range(120)]
    spread = [(1, 200 + k, r.uniform(0, 1000), r.uniform(0, 1000)) for k in range(60)]
    grid = [(2, 400 + k, float(k % 7), float(k // 7)) for k in range(49)] + [(2, 900, 3.0, 3.0), (3, 950, 5.0, 5.0)]
    targets = [*crowd, *spread, *grid]
    places = [(1, r.uniform(-500, 1500), r.uniform(-500, 1500)) for _ in range(40)] + [(1, 500.0, 500.0)] + [(2, a / 2, b / 2) for a in range(14) for b in range(14)] + [(3, -9.0, 1e6), (4, 0.0, 0.0), (2, 3.0, 3.0)]
    got = spatial.nearest(spark.createDataFrame(places, "page int, x double, y double"), spark.createDataFrame(targets, "page int, id long, x double, y double")).collect()
    want = {}
    for p, x, y in places:
        near = [(math.sqrt((a - x) * (a - x) + (b - y) * (b - y)), k) for q, k, a, b in targets if q == p]
        if near:
            want[p, x, y] = min(near)
    assert {(g.page, g.x, g.y): (g.distance, g.id) for g in got} == want and len(got) == len(want)
    none = spark.createDataFrame([], "page int, id long, x double, y double")
    assert spatial.nearest(spark.createDataFrame(places, "page int, x double, y double"), none).count() == 0


def samples(spark, rows):
    return spark.createDataFrame([(1, i, float(d), w) for i, (d, w) in enumerate(rows)], "path_id int, i int, len double, w double")


def test_area_bands(spark):
    r = random.Random(2)
    rows = [(r.uniform(1, 3), None if k % 9 == 4 else 10 + r.gauss(0, 2) * (3 if k % 7 == 0 else 1)) for k in range(40)]
    known = [w for _, w in rows if w is not None]
    mu = sum(known) / len(known)
    sigma = math.sqrt(sum((w - mu) ** 2 for w in known) / len(known))
    least, most = min(known), max(known)
    one, two = [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]
    for (_, a), (d, b) in zip(rows, rows[1:]):
        if a is None or b is None:
            band, wide, w = (least, most), (least, most), None
        else:
            w = (a + b) / 2
            z, up = abs(w - mu) / sigma, w >= mu
            if z <= 1:
                band = wide = (mu - sigma, mu + sigma)
            elif z <= 2:
                band, wide = ((mu + sigma, mu + 2 * sigma) if up else (mu - 2 * sigma, mu - sigma)), (mu - 2 * sigma, mu + 2 * sigma)
            else:
                band, wide = ((mu + 2 * sigma, most) if up else (least, mu - 2 * sigma)), (least, most)
        low, high = max(least, band[0]), min(most, band[1])
        for k, v in enumerate((mu if w is None else min(max(w, low), high), low, high)):
            one[k] += d * v
        for k, v in enumerate((mu, max(least, wide[0]), min(most, wide[1]))):
            two[k] += d * v
    got = stats.area_model_1(samples(spark, rows)).first()
    assert (got.nominal, got.low, got.high) == pytest.approx(tuple(one))
    got = stats.area_model_2(samples(spark, rows)).first()
    assert (got.baseline, got.low, got.high) == pytest.approx(tuple(two))
    sides = sum(got[f"{c}_down"] for c in ("green", "yellow", "red")), sum(got[f"{c}_up"] for c in ("green", "yellow", "red"))
    assert sides == pytest.approx((got.baseline - got.low, got.high - got.baseline))
    got = stats.area_model_3(samples(spark, rows)).first()
    assert got.low <= got.nominal <= got.high
    with pytest.raises(ValueError):
        stats.chosen_widths(samples(spark, rows), "none")


def walked(support, black, size, x, y, dx, dy, most, step, black_run, outside_run, grace):
    """A ray step by step."""
    t, run_b, run_o, first_b, first_o, left = step, 0, 0, None, None, None
    while t <= most:
        px, py = round(x + dx * t), round(y + dy * t)
        if not (0 <= px < size[1] and 0 <= py < size[0]):
            return t
        if (py, px) in black:
            first_b = t if first_b is None else first_b
            run_b += 1
            if run_b >= black_run:
                return first_b
        else:
            run_b, first_b = 0, None
        if (py, px) not in support:
            first_o = t if first_o is None else first_o
            run_o += 1
            if run_o >= outside_run and left is None:
                left = first_o
        else:
            run_o, first_o = 0, None
        if left is not None and t >= left + grace:
            return left if first_b is None else first_b
        t += step
    return first_b if first_b is not None else left


def test_rays_to_black(spark):
    r = random.Random(4)
    size = (20, 24)
    cells = [(y, x) for y in range(size[0]) for x in range(size[1])]
    support, black = {c for c in cells if r.random() < 0.8}, {c for c in cells if r.random() < 0.15}
    rays = [(k, 1, float(r.randrange(24)), float(r.randrange(20)), math.cos(k), math.sin(k)) for k in range(60)]
    df = spark.createDataFrame(rays, "ray_id int, page int, x double, y double, dx double, dy double")
    mask = lambda s: spark.createDataFrame([(1, y, x) for y, x in s], "page int, y int, x int")
    for most, step, b, o, grace in ((12.0, 0.5, 1, 1, 80.0), (15.0, 0.5, 2, 2, 3.0), (9.0, 1.0, 3, 1, 0.0)):
        got = {g.ray_id: g.distance for g in raster.rays_to_black(df, mask(support), mask(black), size, most, step, b, o, grace).collect()}
        assert got == {k: walked(support, black, size, x, y, dx, dy, most, step, b, o, grace) for k, _, x, y, dx, dy in rays}


def test_items(spark):
    rows = [
        (1, 5, 0, "l", 0.0, 0.0, 4.0, 0.0, None, None, None, None), (1, 5, 1, "l", 4.0, 0.0, 4.0, 3.0, None, None, None, None),
        (1, 5, 2, "re", 9.0, 9.0, 10.0, 10.0, None, None, None, None), (1, 5, 3, "c", 5.0, 3.0, 8.0, 3.0, 6.0, 5.0, 7.0, 5.0),
        (1, 6, 0, "l", None, 0.0, 1.0, 1.0, None, None, None, None), (1, 6, 1, "re", 50.0, 50.0, 60.0, 60.0, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "page int, drawing_id int, item_no int, op string, ax double, ay double, bx double, by double, c1x double, c1y double, c2x double, c2y double")
    chain = [(c.x, c.y) for c in items.chained(df, 2).orderBy("i").collect()]
    assert chain == [(0, 0), (4, 0), (4, 3), (5, 3), (6.5, 4.5), (8, 3)]
    points = spark.createDataFrame([(1, 1, 9.5, 12.0), (2, 1, 6.5, 5.0), (3, 2, 0.0, 0.0)], "point_id int, page int, x double, y double")
    hits = items.items_within(df, points, 2.0)
    assert {(h.point_id, h.drawing_id, h.item_no, round(h.distance, 6)) for h in hits.collect()} == {(1, 5, 2, 2.0), (2, 5, 3, 0.5)}
    assert sorted(h.item_no for h in items.whole_drawings(df, hits).collect()) == [0, 1, 2, 3]
    boxes = spark.createDataFrame([(1, 1, 3.0, 2.0, 1.0, 0.2), (2, 1, 9.0, 9.0, 9.1, 30.0)], "drawing_id int, page int, x0 double, y0 double, x1 double, y1 double")
    dots = spark.createDataFrame([(1, 0, 2), (1, 3, 5), (1, 4, 5), (1, 2, 6)], "page int, y int, x int")
    out = items.visibility(items.pixel_boxes(boxes, 2.0, 2.0, 18, 18), dots, 0.1, 2).collect()
    assert [(o.drawing_id, o.px0, o.py0, o.px1, o.py1, o.visible_pixels, o.visibility) for o in out] == [(1, 2, 0, 6, 4, 2, "visible")]


def test_closest_later(spark):
    r = random.Random(3)
    rows = [(1, k, r.randrange(100), r.randrange(100)) for k in range(10) for _ in range(3 + k)]
    ends = items.component_ends(spark.createDataFrame(rows, "page int, component int, y int, x int").distinct(), 1)
    e = sorted(ends.collect(), key=lambda c: c["rank"])
    assert [c.component for c in e] == sorted((c.component for c in e), key=lambda k: (-len(set(x for x in rows if x[1] == k)), k))
    want = {}
    for a in e[:8]:
        later = [(min(math.hypot(p[1] - q[1], p[0] - q[0]) for p in ((a.ay, a.ax), (a.by, a.bx)) for q in ((b.ay, b.ax), (b.by, b.bx))), b["rank"], b.component) for b in e[:8] if b["rank"] > a["rank"]]
        if later:
            want[a.component] = min(later)[2]
    assert {c.a: c.b for c in items.closest_later(ends).collect()} == want


def test_refined_centres(spark):
    r = random.Random(6)
    field = {(y, x): r.uniform(0, 6) for y in range(20) for x in range(30) if r.random() < 0.7}
    start = [(float(3 * k), 10.0) for k in range(10)]
    at = list(start)
    for _ in range(3):
        new = []
        for k, (x, y) in enumerate(at):
            inner, reach = 0 < k < 9, 3 if 0 < k < 9 else 1
            p, n = at[k - 1] if k else at[1], at[k + 1] if k < 9 else at[8]
            mx, my = ((p[0] + n[0]) / 2, (p[1] + n[1]) / 2) if inner else p if k == 9 else n
            best = None
            for (cy, cx), v in sorted(field.items()):
                if (cx - round(x)) ** 2 + (cy - round(y)) ** 2 > reach * reach:
                    continue
                bend = 0.0
                if inner:
                    dx, dy = n[0] - p[0], n[1] - p[1]
                    q = dx * dx + dy * dy
                    t = min(1.0, max(0.0, ((cx - p[0]) * dx + (cy - p[1]) * dy) / q)) if q else 0.0
                    bend = math.hypot(cx - p[0] - t * dx, cy - p[1] - t * dy)
                s = v - 0.03 * ((cx - mx) ** 2 + (cy - my) ** 2) - 0.02 * ((cx - x) ** 2 + (cy - y) ** 2) - 0.015 * bend
                if best is None or s > best[0] + 1e-12:
                    best = (s, float(cx), float(cy))
            new.append((x, y) if best is None else best[1:])
        moved = sum(math.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(at, new)) / 10
        at = new
        if moved < 0.15:
            break
    path = spark.createDataFrame([(1, k, x, y) for k, (x, y) in enumerate(start)], "page int, i int, x double, y double")
    f = spark.createDataFrame([(1, y, x, v) for (y, x), v in field.items()], "page int, y int, x int, v double")
    got = graph.refined_centres(path, f, 3, 1, rounds=3).orderBy("i").collect()
    assert [(g.x, g.y) for g in got] == at


def test_distance_transform(spark):
    r = random.Random(9)
    cells = {(y, x) for y in range(25) for x in range(40) if r.random() < 0.93}
    got = raster.distance_transform(spark.createDataFrame([(1, y, x) for y, x in cells], "page int, y int, x int")).collect()
    around = [(y, x) for y in range(-1, 26) for x in range(-1, 41) if (y, x) not in cells]
    assert len(got) == len(cells)
    assert all(g.v == pytest.approx(min(math.hypot(g.y - a, g.x - b) for a, b in around)) for g in got)


def test_bands_and_rects(spark):
    r = random.Random(5)
    words = [(1, k, x := r.uniform(0, 50), y := r.uniform(0, 30), x + 2, y + 1, r.choice(["a3", "scale", "25"])) for k in range(80)]
    df = spark.createDataFrame(words, "page int, word_no int, x0 double, y0 double, x1 double, y1 double, text string")
    pairs = [(b[2] - a[2], a[1], b[1]) for a in words for b in words if a[6] == "a3" and b[6] == "scale" and abs(a[3] - b[3]) <= 5 and b[2] >= a[2]]
    got = labels.best_pair(df).first()
    assert (got.left_no, got.right_no) == min(pairs)[1:]
    near = {}
    for a in words:
        for b in words:
            if a[6] == "a3" and b[6] == "scale" and abs(a[3] - b[3]) <= 2 and b[2] >= a[4]:
                near[a[1]] = min(near.get(a[1], (1e9, 0)), (b[2] - a[4], b[1]))
    assert {p.left_no: p.right_no for p in labels.token_pairs(df, "a3", "scale", 2.0).collect()} == {k: v[1] for k, v in near.items()}
    mask = spark.createDataFrame([(1, y, x) for y in range(12) for x in range(12)], "page int, y int, x int")
    rects = spark.createDataFrame([(1, 2.0, 3.0, 5.5, 4.0), (2, 0.0, 0.0, 99.0, 99.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert {(p.y, p.x) for p in raster.clear_rects(mask, rects).collect()} == {(y, x) for y in range(12) for x in range(12) if not (3 <= y <= 4 and 2 <= x <= 5)}
    entries = spark.createDataFrame([("Foot  path", "missing", [0.1], 1), ("FOOT PATH ", "ok", [0.2], 2), ("foot path", "ok", [0.3], 3)], "label string, status string, color array<double>, entry_no int")
    assert labels.target_color(entries, "foot path").first().color == [0.2]
    with pytest.raises(Exception, match="no colour"):
        labels.target_color(entries, "kerb").collect()
    parsed = spark.createDataFrame([(["1", "2.5"],), (["1", "x"],), (["1"],), (None,)], "v array<string>").select(labels.numbers(F.col("v"), 2).alias("n")).collect()
    assert [p.n for p in parsed] == [[1.0, 2.5], None, None, None]


def test_small_helpers(spark):
    line = [(1, k, float(k), 0.0) for k in range(12)]
    df = spark.createDataFrame(line, "path_id int, i int, x double, y double")
    assert sorted(c.i for c in curves.every_nth(df, 5).collect()) == [0, 5, 10, 11]
    ends = curves.stations_with_end(df, 4.0).orderBy("station").collect()
    assert [(e.d, e.x, e.tx) for e in ends] == [(0, 0, 1), (4, 4, 1), (8, 8, 1), (11, 11, 1)]
    even = curves.stations_with_end(df.where("i <= 8"), 4.0).orderBy("station").collect()
    assert [e.d for e in even] == [0, 4, 8]
    hook = [(1, 0, 0.0, 0.0), (1, 1, 0.0, 1.0), (1, 2, 0.0, 2.0), (1, 3, 1.0, 2.0)] + [(1, 4 + k, 2.0 + k, 2.0) for k in range(20)]
    out = shapes.hooks_trimmed(spark.createDataFrame(hook, df.schema), 60.0, 5.0).orderBy("i").collect()
    assert (out[0].x, out[0].y) == (1, 2) and out[-1].x == 21  # from there 63 degrees, from the next point 45
    far = curves.origins(spark.createDataFrame([(1, k, 5 * math.cos(k / 9), 5 * math.sin(k / 9)) for k in range(60)], df.schema)).first()
    assert (far.cx, far.cy) == pytest.approx((0, 0), abs=1e-9)


def test_scale_search(spark):
    import numpy as np

    r = np.random.default_rng(3)
    h, w = 16, 18
    edge, held = r.uniform(0, 5, (h, w)), r.random((h, w)) < 0.7
    path = np.array([(2 + 0.8 * k, 5 + 3 * math.sin(k / 4)) for k in range(15)])  # y, x
    origin = path.mean(axis=0)
    field = spark.createDataFrame([(1, y, x, float(edge[y, x]), bool(held[y, x])) for y in range(h) for x in range(w)], "page int, y int, x int, v double, inside boolean")
    df = spark.createDataFrame([(1, k, float(x), float(y)) for k, (y, x) in enumerate(path)], "page int, i int, x double, y double")

    def sample(y, x):
        if y < 0 or x < 0 or y > h - 1 or x > w - 1:
            return 1e6
        a, b = int(y), int(x)
        c, d = min(a + 1, h - 1), min(b + 1, w - 1)
        u, v = y - a, x - b
        return (edge[a, b] * (1 - v) + edge[a, d] * v) * (1 - u) + (edge[c, b] * (1 - v) + edge[c, d] * v) * u

    def total(scale, dy, dx):
        few = [path[k] for k in range(0, 15, 4)] + [path[14]]
        q = [origin + scale * (p - origin) + np.array([dy, dx]) for p in few]
        on = [0 <= round(y) < h and 0 <= round(x) < w and held[round(y), round(x)] for y, x in q]
        gaps = [sample(y, x) for (y, x), k in zip(q, on) if k]
        ends = max(abs(origin[0] + scale * (path[k][0] - origin[0]) + dy - path[k][0]) for k in (0, 14))
        return (float(np.median(gaps)) + 0.25 * float(np.mean(gaps)) if gaps else 1.25e6) + 1000 * sum(not k for k in on) / 15 + 500 * ends

    for lock in (True, False):
        got = graph.scale_search(df, field, spark.createDataFrame([(1, float(origin[1]), float(origin[0]))], "page int, cx double, cy double"), (0.8, 1.0), (-3.0, 3.0), (-3.0, 3.0), (5, 5), 5, 0, nth=4, lock_ends=lock).first()
        best = min((total(s, dy, dx), i) for i, (s, dy, dx) in enumerate((s, dy, dx) for s in np.linspace(0.8, 1, 5) for dy in ([path[[0, 14], 0].mean() - (origin[0] + s * (path[[0, 14], 0] - origin[0])).mean()] if lock else np.linspace(-3, 3, 5)) for dx in np.linspace(-3, 3, 5)))
        assert got.objective == pytest.approx(best[0])
        assert total(got.scale, got.dy, got.dx) == pytest.approx(best[0])


def test_rectangles_and_fills(spark):
    turn = math.radians(30)
    shape = [(1, int(round(40 + a * math.cos(turn) - b * math.sin(turn))), int(round(40 + a * math.sin(turn) + b * math.cos(turn)))) for a in range(-20, 21) for b in range(-8, 9)]
    df = spark.createDataFrame([*shape, (2, 5, 5), (3, 0, 0), (3, 0, 4)], "component int, y int, x int").distinct()
    got = {}
    for c in shapes.smallest_rectangles(df, "component").collect():
        got.setdefault(c.component, []).append(c)
    assert 40 * 16 <= got[1][0].area < 43 * 19 and got[2][0].area == 0 and len(got[3]) == 4
    x0, x1 = min(c.x for c in got[1]), max(c.x for c in got[1])
    assert x0 <= min(x for _, _, x in shape) + 1 and x1 >= max(x for _, _, x in shape) - 1
    ring = [(1, y, x) for y in range(1, 8) for x in range(1, 8) if y in (1, 7) or x in (1, 7)]
    block = [(1, y, x) for y in range(10, 14) for x in range(10, 14)]
    open_ring = [(2, y, x) for y in range(5) for x in range(5) if (y in (0, 4) or x in (0, 4)) and (y, x) != (2, 4)]
    out = raster.largest_filled(spark.createDataFrame([*ring, *block, *open_ring], "page int, y int, x int"), 1, (20, 20)).collect()
    assert {(p.y, p.x) for p in out if p.page == 1} == {(y, x) for y in range(1, 8) for x in range(1, 8)}
    assert {(p.y, p.x) for p in out if p.page == 2} == {(y, x) for _, y, x in open_ring}


def test_collinear_groups(spark):
    rows = [(1, 1, 0.0, 0.0, 0.0), (1, 2, 10.0, 1.0, 2.0), (1, 3, 20.0, 0.0, 178.0), (1, 4, 90.0, 0.0, 0.0), (1, 5, 30.0, 40.0, 0.0), (1, 6, 30.0, 0.0, 90.0)]
    df = spark.createDataFrame(rows, "page int, dash_id long, cx double, cy double, angle double")
    assert [g.group for g in shapes.collinear_groups(df).orderBy("dash_id").collect()] == [0, 0, 0, 1, 2, 3]


def test_manifests(spark):
    from kerbflow.operators import quantities

    m = quantities.run_manifest(spark, {"pdf": "a.pdf"}, {"metrics": "m.json"}).first()
    assert m.inputs == {"pdf": "a.pdf"} and m.outputs["metrics"] == "m.json" and m.written_at is not None
    assert quantities.visual_manifest(spark, "a", "b", "c").first().line_styles["center"].thickness == 1
    df = spark.createDataFrame([("a\\b", [("c\\d", 1)], {"k": "e\\f"}), (None, None, None)], "a string, b array<struct<p: string, n: int>>, m map<string, string>")
    out = quantities.forward_slashed(df).collect()
    assert out[0].a == "a/b" and out[0].b[0].p == "c/d" and out[0].b[0].n == 1 and out[0].m == {"k": "e/f"} and out[1].b is None
