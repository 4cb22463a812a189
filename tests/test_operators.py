"""Operators on handmade cases with known answers."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from kerbflow.functions import geometry as G
from kerbflow.operators import curves, entities, graph, quantities, raster, spatial, stats
from kerbflow.sources import tables
from kerbflow.streaming import audit


def curve(spark, points, key=1):
    return spark.createDataFrame([(key, i, float(x), float(y)) for i, (x, y) in enumerate(points)], "path_id int, i int, x double, y double")


def one(df):
    return df.first()


def test_areas_and_lengths(spark):
    square = curve(spark, [(0, 0), (0, 10), (10, 10), (10, 0)])
    assert one(curves.shoelace_area(square)).area == 100 and one(curves.polyline_length(square)).length == 30
    outer, inner = curve(spark, [(0, 5.5), (100, 5.5)]), curve(spark, [(0, 0), (100, 0)])
    assert one(curves.corridor_area(outer, inner)).area == 550
    assert [r.d for r in curves.arc_length(curve(spark, [(0, 0), (3, 4), (6, 8)])).orderBy("i").collect()] == [0, 5, 10]


def test_circle(spark):
    points = [(50 + 20 * math.cos(k / 60 * math.tau), 40 + 20 * math.sin(k / 60 * math.tau)) for k in range(60)]
    c = one(curves.fit_circle(curve(spark, points)))
    assert (c.cx, c.cy, c.radius) == pytest.approx((50, 40, 20))
    assert one(curves.fit_circle(curve(spark, [(0, 0), (1, 1), (2, 2)]))).radius is None


def test_smoothing(spark):
    flat = curves.smooth_padded(curve(spark, [(5, k) for k in range(12)]), 9, ("x",)).collect()
    assert all(r.x_smooth == pytest.approx(5) for r in flat)
    assert curves.odd_window(4) == 5
    short = curves.smooth_padded(curve(spark, [(1, 0), (9, 0)]), 5, ("x",)).orderBy("i").collect()
    assert [r.x_smooth for r in short] == [1, 9]
    step = curves.smooth_padded(curve(spark, [(0, 0), (0, 1), (3, 2), (3, 3)]), 3, ("x",)).orderBy("i").collect()
    assert [r.x_smooth for r in step] == pytest.approx([0, 1, 2, 3])


def test_filling_and_trimming(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (1, 2, 3.0), (2, 0, None), (2, 1, 2.0), (2, 2, None)], "path_id int, i int, w double")
    assert [r.w_filled for r in curves.interpolated(df, "w").orderBy("path_id", "i").collect()] == [1, 2, 3, 2, 2, 2]
    cut = curves.trimmed(curve(spark, [(0, 0), (10, 0), (20, 0)]), 4, 6).orderBy("d").collect()
    assert [(r.d, r.x) for r in cut] == [(4, 4), (10, 10), (14, 14)]
    assert [r.x for r in curves.stations(curve(spark, [(0, 0), (10, 0)]), 4).orderBy("d").collect()] == [0, 4, 8]


def test_end_rows_and_split(spark):
    df = curve(spark, [(0, 0), (1, 4), (2, 9.4), (3, 0.2), (4, 9)])
    assert [r.i for r in curves.without_end_rows(df).collect()] == [1]
    ring = curves.split_contour(curve(spark, [(k, 0) for k in range(6)]), F.lit(1), F.lit(4))
    arcs = {a: [r.x for r in ring.where(F.col("arc") == a).orderBy("seq").collect()] for a in (0, 1)}
    assert arcs == {0: [1, 2, 3, 4], 1: [1, 0, 5, 4]}


def test_links(spark):
    hits = spark.createDataFrame([(1, 1, 0.0, 0.0), (2, 1, -1.0, -1.0), (3, 2, 0.0, 0.0)], "hit_id int, page int, x double, y double")
    d = spark.createDataFrame([(9, 1, 99.0, -1.0, 101.0, 1.0), (8, 1, 149.0, 0.0, 151.0, 0.0)], "drawing_id int, page int, x0 double, y0 double, x1 double, y1 double")
    out = {r.hit_id: r for r in entities.nearest_drawing(hits, d).collect()}
    assert (out[1].linked_drawing_id, out[1].score, out[2].score, out[3].link_status) == (9, 0.5, 0, "unlinked")
    assert one(spark.range(1).select(G.link_score(F.lit(150.0)).alias("s"))).s == 0.4
    assert {r.hit_id for r in entities.review_queue(entities.nearest_drawing(hits, d)).collect()} == {2, 3}


def test_labels(spark):
    texts = ["GAP65 base", "GAP 65", "Subsoil drain", "concierge", "xyz"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(G.feature_type(F.col("text"))).collect()] == ["gap65", None, "subsoil_drain", "concrete", None]
    assert {(r.text, r.keyword) for r in entities.keyword_hits(df).collect()} == {("GAP65 base", "gap65"), ("GAP 65", "gap65"), ("Subsoil drain", "subsoil drain")}
    assert [r[0] for r in spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "v double").select(G.to_pixel(F.col("v"), 1)).collect()] == [0, 2, 2, 0]


def test_calibration(spark):
    ticks = spark.createDataFrame([(1, 0, 10.0), (1, 25, 151.732), (1, 50, 400.0)], "page int, value int, x double")
    c = one(entities.calibration(ticks, 220))
    assert (c.m_per_pt, c.m_per_px) == pytest.approx((0.176389, 0.0577273), abs=1e-6)


def test_widths(spark):
    df = spark.createDataFrame([(1, i, 1.0, w) for i, w in enumerate((10.0, 10.0, 11.0, 12.0, 50.0))], "path_id int, i int, len double, w double")
    out = stats.mad_filter(df, 2.5).collect()
    assert {(r.med, r.mad) for r in out} == {(11, 1)} and [r.w for r in out if not r.mad_kept] == [50]
    z = spark.createDataFrame([(1.0,), (1.5,), (2.0,), (2.1,), (None,)], "z double")
    assert [r[0] for r in z.select(G.sigma_class(F.col("z"))).collect()] == ["green", "yellow", "yellow", "red", "red"]
    a = one(stats.area_model_1(stats.sigma_classed(df)))
    assert a.low <= a.nominal <= a.high


def test_quantities(spark):
    facts = quantities.DESIGN_FACTS
    out = {r.quantity: r.value for r in quantities.quantities(spark.createDataFrame([tuple(facts.values())], list(facts))).collect()}
    assert out == {"joal_3d_area": 1519.7657, "concrete_volume": 239.3631, "gap65_area": 1657.9262, "gap65_volume": 261.1234, "flush_nib_length": 269.2052, "subsoil_drain_length": 232.1945, "footpath_volume": 134.3556}


def test_spatial_joins_match_nested_loops(spark):
    r = random.Random(1)
    rows = [(k, k % 2, x := r.uniform(-40, 40), y := r.uniform(-40, 40), x + r.uniform(0, 9), y + r.uniform(0, 9)) for k in range(150)]
    df = spark.createDataFrame(rows, "drawing_id int, page int, x0 double, y0 double, x1 double, y1 double")
    for gap in (0.0, 1.5):
        want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[4] + gap >= b[2] and b[4] + gap >= a[2] and a[5] + gap >= b[3] and b[5] + gap >= a[3]}
        got = [(p.a, p.b) for p in spatial.self_overlap_pairs(df, 7.0, gap).collect()]
        assert len(got) == len(want) and set(got) == want
    pts = df.select("drawing_id", "page", F.col("x0").alias("x"), F.col("y0").alias("y"))
    far = lambda a, b: math.hypot(a[2] - b[2], a[3] - b[3])
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and far(a, b) < 6}
    assert {(p.a, p.b) for p in spatial.radius_pairs(pts, 6.0, "drawing_id").collect()} == want


def test_box_clusters(spark):
    boxes = [(0, 1, 0.0, 0.0, 2.0, 2.0), (1, 1, 2.5, 0.0, 4.0, 2.0), (2, 1, 4.5, 0.0, 6.0, 2.0), (3, 1, 20.0, 0.0, 22.0, 2.0)]
    df = spark.createDataFrame(boxes, "drawing_id long, page int, x0 double, y0 double, x1 double, y1 double")
    labels = graph.connected_components(df.select(F.col("drawing_id").alias("node")), spatial.self_overlap_pairs(df, 5.0, 1.0))
    assert {r.node: r.component for r in labels.collect()} == {0: 0, 1: 0, 2: 0, 3: 3}


def test_components_of_a_long_path(spark):
    n = spark.range(300).withColumnRenamed("id", "node")
    e = n.where("node < 299").select(F.col("node").alias("a"), (F.col("node") + 1).alias("b"))
    assert {r.component for r in graph.connected_components(n, e).collect()} == {0}
    assert {r.component for r in graph.connected_components(n, e.where("a < 0")).collect()} == set(range(300))


def test_greedy_seeds(spark):
    df = spark.createDataFrame([(1, 0, x) for x in range(100)], "page int, y int, x int")
    assert [r.x for r in graph.greedy_seeds(df, 40).orderBy("seed").collect()] == [0, 41, 82]


def test_paths(spark):
    r = random.Random(3)
    e = sorted({(min(a, b), max(a, b)) for a, b in ((r.randrange(30), r.randrange(30)) for _ in range(60)) if a != b})
    rows = [(1, a, b, float(r.randrange(1, 20))) for a, b in e]
    df = spark.createDataFrame(rows, "page int, a long, b long, cost double")
    best, heap = {}, [(0.0, rows[0][1])]
    while heap:
        d, v = heapq.heappop(heap)
        if v not in best:
            best[v] = d
            heap += [(d + c, q) for _, a, b, c in rows for p, q in ((a, b), (b, a)) if p == v]
            heapq.heapify(heap)
    start = spark.createDataFrame([(1, rows[0][1])], "page int, node long")
    assert {x.node: x.distance for x in graph.shortest_distances(df, start).collect()} == best
    deg = {}
    for x in graph.path_edges(df).collect():
        deg[x.a], deg[x.b] = deg.get(x.a, 0) + 1, deg.get(x.b, 0) + 1
    assert max(deg.values()) <= 2
    line = spark.createDataFrame([(1, k, k + 1, 1.0) for k in range(5)], df.schema)
    assert [x.node for x in graph.main_path(line).orderBy("i").collect()] in ([0, 1, 2, 3, 4, 5], [5, 4, 3, 2, 1, 0])
    assert [x.node for x in graph.ordered_walk(line).orderBy("i").collect()] == [0, 1, 2, 3, 4, 5]


def test_forward_progress(spark):
    rows = [(1, 0, 0.0, 0.0, 1.0, 0.0), (1, 1, 2.0, 0.0, 1.0, 0.0), (1, 2, 1.5, 1.0, 1.0, 0.0), (1, 3, 3.0, 0.0, 1.0, 0.0)]
    out = graph.forward_progress(spark.createDataFrame(rows, "path_id int, i int, x double, y double, tx double, ty double")).orderBy("i").collect()
    assert [r.x for r in out] == [0, 2, 2, 3]


def test_masks(spark):
    block = spark.createDataFrame([(1, y, x) for y in range(2, 7) for x in range(2, 7)], "page int, y int, x int")
    k = raster.box_kernel(3)
    assert raster.eroded(block, k).count() == 9 and raster.dilated(block, k).count() == 49
    assert raster.opened(block, k).count() == 25 and raster.closed(block, k).count() == 25
    d = {(r.y, r.x): r.v for r in raster.distance_transform(block).collect()}
    assert d[4, 4] == 3 and d[2, 2] == 1 and d[3, 4] == 2
    thin = raster.skeleton(spark.createDataFrame([(1, y, x) for y in range(3) for x in range(20)], "page int, y int, x int")).collect()
    assert 0 < len(thin) < 25 and {r.y for r in thin} == {1}
    square = spark.createDataFrame([(1, 1, i, x, y) for i, (x, y) in enumerate([(0.5, 0.5), (4.5, 0.5), (4.5, 3.5), (0.5, 3.5)])], "page int, polygon_id int, i int, x double, y double")
    assert raster.filled_polygons(square).count() == 12
    assert graph.skeleton_length(spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 1, 2)], "page int, y int, x int")).first().length == pytest.approx(1 + 2**0.5)


def test_rays(spark):
    mask = spark.createDataFrame([(1, 0, x) for x in range(6)], "page int, y int, x int")
    rays = spark.createDataFrame([(1, 1, 1.0, 0.0, 1.0, 0.0), (2, 1, 9.0, 0.0, 1.0, 0.0)], "ray_id int, page int, x double, y double, dx double, dy double")
    out = {r.ray_id: (r.last_inside, r.first_outside) for r in raster.marched(rays, mask, 0.5, 20).collect()}
    assert out == {1: (4.0, 4.5), 2: (None, None)}  # 5.5 is rounded to 6
    black = spark.createDataFrame([(1, 0, 4), (1, 0, 5), (1, 0, 6)], "page int, y int, x int")
    assert {r.ray_id: r.distance for r in raster.first_black(rays, black, 1.0, 20, 2).collect()} == {1: 3.0, 2: None}


def test_sources(spark, tmp_path):
    spans = spark.createDataFrame([(1, 0, 1, "b", [5.0, 0.0, 9.0, 2.0]), (1, 0, 0, "a", [0.0, 1.0, 4.0, 3.0]), (1, 1, 0, " ", [0.0, 0.0, 1.0, 1.0])], tables.SPANS)
    assert [(r.text, r.bbox) for r in tables.text_lines(spans).collect()] == [("a b", [0, 0, 9, 3])]
    tables.write(spans, str(tmp_path / "t"), by_page=True)
    assert tables.pages(spark.read.parquet(str(tmp_path / "t")), 1).count() == 3
    (tmp_path / "g.json").write_text('{"seeds": [{"id": 1, "x": 2, "y": 3}, {"id": 2, "active": false}], "edges": [{"a": 1, "b": 2}], "endpoint_ids": [2, 1]}')
    g = tables.read(spark, str(tmp_path / "g.json"), "graph")
    assert [r.id for r in tables.graph_seeds(g).collect()] == [1] and [r.id for r in tables.graph_ends(g).orderBy("i").collect()] == [2, 1]


def test_audit_stream(spark, tmp_path):
    rows = [(2, 1, 1, "a"), (3, 2, 2, "b"), (3, 3, 3, "c"), (5, 4, 4, "d")]
    schema = "step_id int, arrival int, entry_id int, decision string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = audit.upsert(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    assert {(r.step_id, r.decision) for r in audit.current(spark, str(tmp_path / "out")).collect()} == {(2, "a"), (3, "c"), (5, "d")}
    got = quantities.latest_audit(spark.createDataFrame(rows, schema), ["arrival", "entry_id"]).collect()
    assert {(r.step_id, r.decision) for r in got} == {(2, "a"), (3, "c"), (5, "d")}


def test_contours_and_centres(spark):
    block = [(1, 7, y, x) for y in range(3) for x in range(4)] + [(1, 9, 8, 8)]
    df = spark.createDataFrame(block, "page int, component int, y int, x int")
    out = {c: [(r.y, r.x) for r in raster.contours(df).where(F.col("component") == c).orderBy("i").collect()] for c in (7, 9)}
    assert out == {7: [(0, 0), (0, 1), (0, 2), (0, 3), (1, 3), (2, 3), (2, 2), (2, 1), (2, 0), (1, 0)], 9: [(8, 8)]}
    runs = spark.createDataFrame([(1, 0, 0, 2), (1, 0, 10, 20), (1, 1, 0, 2), (1, 1, 12, 14), (1, 2, 0, 1)], "page int, y int, first int, last int")
    assert [r.x for r in curves.row_centres(runs).orderBy("y").collect()] == [15, 13, 0.5]
    line = curves.extended(curve(spark, [(0, 0), (3, 4)]), spark.createDataFrame([(1, 5.0)], "path_id int, distance double")).orderBy("i").collect()
    assert [(r.x, r.y) for r in line] == [(0, 0), (3, 4), (6, 8)]


def test_color_hits_of_many_colors(spark):
    r = random.Random(3)
    pick = lambda: [r.randrange(5) / 4 for _ in range(3)]
    shown = [(pick(), None if k % 5 == 0 else pick()) for k in range(40)]
    asked = [(k, None if k == 7 else pick()) for k in range(10_050)]
    colors = spark.createDataFrame(asked, "color_id long, color array<double>")
    drawings = spark.createDataFrame(shown, "fill array<double>, stroke array<double>")
    near = lambda a, b: a is not None and b is not None and math.sqrt(sum((x - y) * (x - y) for x, y in zip(a, b))) <= 0.25
    memo = {}
    for k, c in asked:
        key = c and tuple(c)
        if key not in memo:
            f, s = [near(x, c) for x, _ in shown], [near(y, c) for _, y in shown]
            memo[key] = (sum(f), sum(s), sum(p or q for p, q in zip(f, s)))
    got = {row.color_id: (row.fill_hits, row.stroke_hits, row.matched) for row in entities.color_hits(colors, drawings, 0.25).collect()}
    assert got == {k: memo[c and tuple(c)] for k, c in asked}
    assert entities.color_hits(colors, drawings.limit(0), 0.25).count() == 0
