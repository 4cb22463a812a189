"""Footpath areas against a plain version, over the whole table and on a straight band."""

import math
import os
from collections import defaultdict

import numpy as np
import pytest
from test_pixels import by_page, plain_rescue, plain_widths

from kerbflow.operators import footpath
from kerbflow.plans import pixels

SF = "/root/testdata/sf0.001"


def hsv(r, g, b):
    high, low = max(r, g, b), min(r, g, b)
    span = high - low
    turn = 0.0 if not span else 60.0 * (g - b) / span if high == r else 120 + 60.0 * (b - r) / span if high == g else 240 + 60.0 * (r - g) / span
    return round((turn % 360) / 2) % 180, round(255.0 * span / high) if high else 0, high


def plain_masks(mask, picture, size, s):
    k = s.close_kernel // 2
    disc = [(a, b) for a in range(-k, k + 1) for b in range(-k, k + 1) if a * a + b * b <= k * k]
    inside = lambda p: 0 <= p[0] < size[0] and 0 <= p[1] < size[1]
    wide = {q for p in mask for a, b in disc if inside(q := (p[0] + a, p[1] + b))}
    raw = {p for p in wide if all((p[0] + a, p[1] + b) in wide for a, b in disc if inside((p[0] + a, p[1] + b)))}
    support, black = set(raw), set()
    for p, (r, g, b) in picture.items():
        h, sat, v = hsv(r, g, b)
        good = v >= s.support_value or sat <= s.gray_saturation and v >= s.gray_value or s.green_hue[0] <= h <= s.green_hue[1] and sat >= s.green_saturation and v >= s.green_value
        if good and any((p[0] + a, p[1] + c) in raw for a in range(-2, 3) for c in range(-2, 3) if math.hypot(a, c) <= s.support_pad):
            support.add(p)
        if v <= s.black_value:
            black.add(p)
    return support, black


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_footpath_areas_query(spark):
    s, size = pixels.SMALL, pixels.SIZE
    masks, pictures = by_page(pixels.corridor(spark, SF)), by_page(pixels.pictures(spark, SF), "r", "g", "b")
    got = {r.path_id: r for r in pixels.footpath_areas(spark, SF).collect()}
    rejected = rescued = 0
    for page, mask in masks.items():
        support, black = plain_masks(set(mask), pictures[page], size, s)
        way = [(12 + (2 + 3 * i) / 4, 2.0 + 3 * i) for i in range(10)]
        dense = [way[0]]
        for (x0, y0), (x1, y1) in zip(way, way[1:]):
            n = max(1, math.floor(math.hypot(x1 - x0, y1 - y0) / s.step))
            dense += [(x0 + (x1 - x0) * k / n, y0 + (y1 - y0) * k / n) for k in range(1, n + 1)]
        points = []
        for x, y in dense:
            p, q = round(y), round(x)
            best = min((a * a + b * b, p + a, q + b) for a in range(-3, 4) for b in range(-3, 4) if (p + a, q + b) in support) if any((p + a, q + b) in support for a in range(-3, 4) for b in range(-3, 4)) else None
            points.append((float(best[2]), float(best[1]), x, y) if best and best[0] else (x, y, x, y))
        rows = plain_rescue(plain_widths(support, black, points, size, s.max_probe, s.probe_step, s.outside_grace), support, black, size, s.max_probe, s.probe_step)
        vals = [r[4] for r in rows if r[4] is not None]
        top = np.median(vals) + 2 * np.std(vals) if len(vals) >= 4 else math.inf
        out = sum(r[4] is not None and r[4] > top for r in rows)
        widths = [r[4] if r[4] is not None and r[4] <= top else None for r in rows]
        own = [w for w in widths if w is not None]
        mu, sd = np.mean(own), np.std(own)

        def bounds(w):
            z = abs(w - mu) / sd if sd > 1e-6 else 0.0  # noqa: B023
            d = 0.0 if z <= 1 else sd if z <= 2 else 2 * sd  # noqa: B023
            return max(0.0, w - d), w + d

        length = area = low = high = pairs = 0
        for a, b, v, w in zip(rows, rows[1:], widths, widths[1:]):
            d = math.hypot(a[0] - b[0], a[1] - b[1])
            length += d
            if v is not None and w is not None:
                area += d * (v + w) / 2
                low += d * (bounds(v)[0] + bounds(w)[0]) / 2
                high += d * (bounds(v)[1] + bounds(w)[1]) / 2
                pairs += 1
        r = got[page]
        assert (r.pairs, r.rescued, r.rejected) == (pairs, sum(x[6] for x in rows), out)
        want = [length * 0.05, area * 0.0025, low * 0.0025, high * 0.0025, np.median(own), mu, sd]
        assert np.allclose([r.length_m, r.area_m2, r.area_min_m2, r.area_max_m2, r.w_median, r.w_mean, r.w_std], want, atol=2e-6)
        rejected, rescued = rejected + out, rescued + r.rescued
    assert len(got) == len(masks) and rejected and rescued


def test_straight_band(spark):
    n = 60
    white = [(1, y, x, 255, 255, 255) if 10 <= x < 30 else (1, y, x, 0, 0, 0) for y in range(n) for x in range(n)]
    picture = spark.createDataFrame(white, "page int, y int, x int, r int, g int, b int")
    mask = picture.where("r > 0").select("page", "y", "x")
    path = spark.createDataFrame([(4, 0, 1, 19.0, 5.0), (4, 1, 1, 20.0, 30.0), (4, 2, 1, 20.0, 55.0), (5, 0, 1, 50.0, 5.0), (5, 1, 1, 50.0, 9.0)], "path_id int, i int, page int, x double, y double")
    w = footpath.path_widths(path, mask, picture, (n, n))
    far = defaultdict(list)
    for r in w.collect():
        far[r.path_id].append(r)
    assert {r.reason for r in far[5]} == {"center_not_on_support"} and not any(r.valid for r in far[5])
    assert all(abs(r.w - 21) <= 1 for r in far[4])
    area = {r.path_id: r for r in footpath.path_areas(w, 0.1).collect()}
    assert abs(area[4].area_m2 - 0.1 * 0.1 * 50 * 21) < 1 and area[5].area_m2 == 0 and area[5].pairs == 0
