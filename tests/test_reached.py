"""Links, pictures, scans and single operators against plain versions."""

import json
import math
import os
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kerbflow.operators import boundary, linking, raster, shapes
from kerbflow.plans import pixels, reached
from kerbflow.plans.queries import QUERIES
from kerbflow.sources import images, tables

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


# -- links --------------------------------------------------------------------------------


def greedy(rows):
    taken, left, right = set(), set(), set()
    for page, label, drawing, score in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if (page, label) not in left and (page, drawing) not in right:
            taken.add((page, label, drawing))
            left.add((page, label))
            right.add((page, drawing))
    return taken


@needs_tables
def test_weighted_links_query(spark):
    scores = linking.link_scores(reached.hit_labels(spark, SF), reached.styled_drawings(spark, SF), reached.RADIUS)
    rows = [(r.page, r.label_id, r.drawing_id, r.score) for r in scores.collect() if r.score >= 0.6]
    found = QUERIES["weighted_links"](spark, SF).collect()
    assert {(r.page, r.label_id, r.drawing_id) for r in found if r.drawing_id is not None} == greedy(rows)
    assert len(found) == reached.hit(spark, SF).count() and all((r.link_status == "linked") == (r.drawing_id is not None) for r in found)


def test_one_to_one_rivals(spark):
    chain = [(1, k, k + d, 1.0 - 0.01 * (2 * k + d)) for k in range(12) for d in (0, 1)]  # each choice decides the next
    ties = [(2, a, b, 0.5) for a in range(4) for b in range(3)]
    rows = chain + ties + [(3, 1, 1, 0.1)]
    df = spark.createDataFrame([(*r[:3], 1.0, r[3]) for r in rows], "page int, label_id long, drawing_id long, distance double, score double")
    got = {(r.page, r.label_id, r.drawing_id) for r in linking.one_to_one(df, 0.2).collect()}
    assert got == greedy([r for r in rows if r[3] >= 0.2])
    assert linking.one_to_one(df.where("page > 9")).count() == 0


# -- pictures -------------------------------------------------------------------------------


def png(pixels, depth, color, filters, palette=None):
    """A PNG file whose rows use the given filters in turn; ``pixels`` are bytes of packed rows."""
    step = max(1, images.CHANNELS[color] * depth // 8)
    above, out = bytes(len(pixels[0])), b""
    for k, line in enumerate(pixels):
        kind = filters[k % len(filters)]
        row = bytearray()
        for x, v in enumerate(line):
            a, b, c = (line[x - step] if x >= step else 0), above[x], (above[x - step] if x >= step else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        out += bytes([kind]) + bytes(row)
        above = line
    width = len(pixels[0]) * 8 // depth // images.CHANNELS[color]
    chunk = lambda kind, body: struct.pack(">I4s", len(body), kind) + body + struct.pack(">I", zlib.crc32(kind + body))
    z = zlib.compress(out)
    body = chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(pixels), depth, color, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"")
    return images.SIGNATURE + body + chunk(b"IDAT", z[:5]) + chunk(b"IDAT", z[5:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("filters", [(0,), (1,), (2,), (3,), (4,), (4, 1, 3, 0, 2)])
@pytest.mark.parametrize("color,depth", [(0, 8), (0, 16), (2, 8), (4, 8), (6, 8), (0, 1), (0, 4), (3, 8), (3, 2)])
def test_png(filters, color, depth):
    r = np.random.default_rng(7)
    rows = [bytes(r.integers(0, 4 if color == 3 and depth == 8 else 256, 24 * images.CHANNELS[color], dtype=np.uint8)) for _ in range(11)]
    palette = bytes(range(200, 212))
    got = images.decoded(png(rows, depth, color, filters, palette if color == 3 else None))
    flat = np.array([list(x) for x in rows])
    if depth < 8:
        flat = np.array([[(b >> s) & ((1 << depth) - 1) for b in x for s in range(8 - depth, -1, -depth)] for x in rows])
    if depth == 16:
        flat = flat[:, ::2]
    p = flat.reshape(len(rows), -1, images.CHANNELS[color])
    if color == 3:
        p = np.array(list(palette)).reshape(-1, 3)[p[:, :, 0]]
    grey = np.rint(p[:, :, :3] @ np.array([0.299, 0.587, 0.114])) if p.shape[2] >= 3 else p[:, :, 0] * (255 // ((1 << depth) - 1) if depth < 8 and color == 0 else 1)
    assert got.shape == grey.shape and (got == grey).all()


def test_mask_files_on_disk(spark, tmp_path):
    m = spark.createDataFrame([(p, y, (y * p) % 7) for p in (1, 2, 3) for y in range(9)], "page int, y int, x int")
    (tmp_path / "deep").mkdir()
    for r in raster_files(m):
        (tmp_path / "deep" / f"{r.page}.png").write_bytes(bytes(r.content))
    (tmp_path / "other.txt").write_text("no picture")
    got = images.read_masks(spark, str(tmp_path)).withColumn("page", F.regexp_extract("path", r"(\d+)\.png$", 1).cast("int"))
    assert sorted((r.page, r.y, r.x, r.v) for r in got.collect()) == sorted((*r, 255) for r in m.collect())
    (tmp_path / "bad.png").write_bytes(images.SIGNATURE + b"nothing")
    with pytest.raises(PySparkException, match="Failed to read mask"):
        images.read_masks(spark, str(tmp_path)).collect()


def raster_files(m):
    return images.mask_files(m, (9, 7)).collect()


# -- scans ------------------------------------------------------------------------------------


def test_vector_scan(spark, tmp_path):
    rows = [(p, k, k, "fs", [0.0, 0.0, 1.0 * k, 2.0], [[["l", [0.0, 0.0], None, None, [1.0, 1.0], None, None, None, None]]][0]) for p in (1, 2, 5) for k in range(p + 1)]
    kind = "page int, index_on_page int, seqno int, type string, rect array<double>, path_items array<struct<op string, p0 array<double>, c1 array<double>, c2 array<double>, p1 array<double>, rect array<double>, orientation double, quad string, raw string>>"
    path = str(tmp_path / "vectors")
    tables.write(spark.createDataFrame(rows, kind), path, by_page=True)
    assert tables.vector_scan(spark, path).count() == 2 + 3 + 6
    one = tables.vector_scan(spark, path, 5)
    assert one.count() == 6 and {r.page for r in one.collect()} == {5}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(page" in plan and "DataFilters: []" in plan  # only the folder of the page is read
    assert tuple(tables.scan_summary(tables.vector_scan(spark, path)).first()) == (3, 11, [1, 2, 5])
    for page in (3, 99, -1):
        with pytest.raises(ValueError, match=f"Page out of range: {page}"):
            tables.vector_scan(spark, path, page)


def test_required_keys(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"line_yx": [[1.0, 2.0], [3.5, 4.0]], "other": 1}))
    bad.write_text(json.dumps({"line_yx": []}))
    assert [tuple(r) for r in tables.curve(spark, str(good), "line_yx").collect()] == [(0, 1.0, 2.0), (1, 3.5, 4.0)]
    for path, key in ((bad, "line_yx"), (good, "none")):
        with pytest.raises(PySparkException, match=f"Missing key {key}"):
            tables.curve(spark, str(path), key).collect()
    with pytest.raises(ValueError, match="Missing key"):
        tables.required(spark.range(1), "none", "here")


# -- single operators ---------------------------------------------------------------------------


@needs_tables
def test_absorbed_fragments_query(spark):
    parts = defaultdict(lambda: defaultdict(set))
    for r in reached.fragments(spark, SF).collect():
        parts[r.page][r.component].add((r.y, r.x))
    want = set()
    for page, own in parts.items():
        whole = set(own.get(1, ()))
        want.add((page, 1))
        for k in sorted(set(own) - {1}):
            if any((y + a, x + b) in whole for y, x in own[k] for a in range(-2, 3) for b in range(-2, 3)):
                whole |= own[k]
                want.add((page, k))
    assert {tuple(r) for r in QUERIES["absorbed_fragments"](spark, SF).collect()} == want


@needs_tables
def test_ends_extended_query(spark):
    masks = defaultdict(set)
    for r in pixels.corridor(spark, SF).collect():
        masks[r.page].add((r.y, r.x))
    got = defaultdict(list)
    for r in QUERIES["ends_extended"](spark, SF).collect():
        got[r.path_id].append((r.i, r.y, r.x))
    way = np.array([(2.0 + 3 * i, 12 + (2 + 3 * i) / 4) for i in range(3, 7)])
    for page, own in got.items():
        line = [tuple(p) for p in way]
        for head in (True, False):
            p, q = (way[0], way[2]) if head else (way[-1], way[-3])
            d = (p - q) / np.linalg.norm(p - q)
            k = 0
            while (round(p[0] + d[0] * 0.5 * (k + 1)), round(p[1] + d[1] * 0.5 * (k + 1))) in masks[page]:
                k += 1
            if k:
                n = max(2, round(0.5 * k))
                more = [tuple(p + d * 0.5 * k * j / n) for j in range(1, n + 1)]
                line = more[::-1] + line if head else line + more
        own = sorted(own)
        assert [i for i, *_ in own] == list(range(len(line)))
        assert np.allclose([p[1:] for p in own], line, atol=1e-5)


def test_short_lines_stay(spark):
    m = spark.createDataFrame([(1, y, x) for y in range(9) for x in range(9)], "page int, y int, x int")
    c = spark.createDataFrame([(7, 0, 1, 4.0, 4.0), (7, 1, 1, 5.0, 4.0)], "path_id int, i int, page int, x double, y double")
    assert sorted(tuple(r) for r in boundary.ends_extended(c, m).collect()) == [(7, 0, 4.0, 4.0), (7, 1, 5.0, 4.0)]


def test_lengths_without_width(spark):
    s = spark.createDataFrame([(1, 50, 20, 0.0), (2, 50, 20, 5.0)], "page int, area_px long, skeleton_px long, width_px double")
    got = {r.page: (r.skeleton_m, r.outline_m, r.area_m2, r.by_width_m) for r in shapes.measured_lengths(s, 0.5).collect()}
    assert got == {1: (10.0, 5.0, 12.5, None), 2: (10.0, 5.0, 12.5, 5.0)}


def test_drawn_pixels(spark):
    square = [(0, 1, i, x, y) for i, (x, y) in enumerate([(1.0, 1.0), (5.0, 1.0), (5.0, 4.0), (1.0, 4.0)])]
    polygons = spark.createDataFrame(square, "page int, polygon_id int, i int, x double, y double")
    boxes = spark.createDataFrame([(0, 9.6, 7.5, 8.4, 8.5)], "page int, x0 double, y0 double, x1 double, y1 double")
    strokes = spark.createDataFrame([(0, 0.0, 20.0, 6.0, 20.0, 4.0)], "page int, ax double, ay double, bx double, by double, width double")
    got = {(r.y, r.x) for r in raster.drawn_pixels(polygons, boxes, strokes).collect()}
    inside = {(y, x) for y in range(1, 4) for x in range(1, 6)}
    stroke = {(y, x) for y in range(18, 23) for x in range(-2, 9) if math.hypot(y - 20, max(0, -x, x - 6)) <= 2}
    assert got == inside | {(8, x) for x in (8, 9, 10)} | stroke


def test_results(spark, tmp_path):
    assert tuple(tables.results(spark, str(tmp_path)).first()) == (None, None, "none")
    (tmp_path / "run_summary.json").write_text(json.dumps({"mask": "out\\masks\\a.png", "n": 2}, indent=1))
    first = tables.results(spark, str(tmp_path)).first()
    assert json.loads(first.summary) == {"mask": "out/masks/a.png", "n": 2} and first.metrics is None and first.error is None
    (tmp_path / "metrics.json").write_text(json.dumps({"area": 1.5}))
    assert json.loads(tables.results(spark, str(tmp_path)).first().metrics) == {"area": 1.5}


def test_write_run(spark, tmp_path):
    tables.write_run(str(tmp_path), links=spark.range(3), summary=spark.range(1))
    assert spark.read.parquet(str(tmp_path / "links")).count() == 3 and spark.read.parquet(str(tmp_path / "summary")).count() == 1
