"""Steps whose share of a task must not grow with the table."""

from kerbflow.operators import graph, raster, spatial
from kerbflow.plans import queries


def test_spread_by_counted_rows(spark):
    df = spark.range(1000)
    assert graph.spread(df, "id", rows=10).rdd.getNumPartitions() == 100
    assert graph.spread(df, rows=10, n=200).rdd.getNumPartitions() == 20
    assert graph.spread(df.limit(1)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_degrees_of_nodes_only(spark):
    nodes, e = spark.createDataFrame([(1,), (1,), (2,), (9,)], "node long"), spark.createDataFrame([(1, 2), (1, 5)], "a long, b long")
    assert sorted(map(tuple, graph.degrees(nodes, e).collect())) == [(1, 2), (2, 1), (9, 0)]


def test_drawings_leave_their_one_file_before_they_become_pixels(spark):
    """A table in one partition is dealt out before each drawing becomes many rows."""
    d = spark.createDataFrame([(k, 1, 0.0, 0.0, 1.0, 1.0) for k in range(50)], "drawing_id long, page int, x0 double, y0 double, x1 double, y1 double").coalesce(1)
    for made in (raster.first_drawn(d), spatial.self_overlap_pairs(d, 16.0)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" in plan and "RepartitionByExpression" in plan[plan.index("Generate") :] or "Repartition " in plan[plan.index("Generate") :]


def test_nearest_makes_no_row_for_each_pair(spark):
    places = spark.createDataFrame([(1, 0.5, 0.5)], "page int, x double, y double")
    targets = spark.createDataFrame([(k, 1, float(k % 7), float(k % 5)) for k in range(35)], "id long, page int, x double, y double")
    out = spatial.nearest(places, targets)
    assert [tuple(r)[:4] for r in out.collect()] == [(1, 0.5, 0.5, 0)]
    assert "array_min" in out._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_makes_no_levels_for_pages_of_few_targets(spark, monkeypatch):
    """Sixteen levels of cells had been made and counted, however few targets a page had."""
    made = []
    monkeypatch.setattr(spatial, "checkpointed", lambda df: made.append(df.columns) or graph.checkpointed(df))
    places = spark.createDataFrame([(1, 0.5, 0.5), (3, 1.0, 1.0)], "page int, x double, y double")
    targets = spark.createDataFrame([(k, 1 + k % 2, float(k % 7), float(k % 5)) for k in range(35)], "id long, page int, x double, y double")
    assert spatial.nearest(places, targets).count() == 1
    assert len(made) == 1 and "level" not in made[0]


def test_nearest_on_crowded_and_other_pages(spark, monkeypatch):
    monkeypatch.setattr(spatial, "LEAF", 4)
    targets = [(100 - k, 1 + k % 3, float(k * 7 % 11), float(k * k % 5)) for k in range(60)] + [(k, 9, float(k), 0.0) for k in range(4)]
    places = [(page, x / 2, y / 2) for page in (1, 2, 3, 9, 10) for x in range(0, 20, 3) for y in range(0, 9, 3)]
    want = {}
    for page, x, y in places:
        near = [(((tx - x) ** 2 + (ty - y) ** 2) ** 0.5, k) for k, p, tx, ty in targets if p == page]
        if near:
            want[page, x, y] = min(near)
    got = spatial.nearest(spark.createDataFrame(places, "page int, x double, y double"), spark.createDataFrame(targets, "id long, page int, x double, y double"))
    assert {(r.page, r.x, r.y): (r.distance, r.id) for r in got.collect()} == want


def test_hits_without_a_drawing_do_not_meet_in_one_task(spark, tmp_path):
    orders = spark.range(200).selectExpr("id * 10 as o_orderkey", "id as o_custkey", "'a' as o_orderpriority")  # none has a place
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    part = spark.range(50).selectExpr("id as p_partkey", "1 as p_size", "double(id) as p_retailprice", "'n' as p_name", "'t' as p_type")
    part.write.parquet(f"{tmp_path}/part.parquet")
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        rows = queries.links(spark, str(tmp_path)).select("length").rdd.glom().map(len).collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert sum(rows) == 200 and max(rows) < 100


def test_places_of_pages_are_made_in_many_tasks(spark, monkeypatch):
    """Pages are few rows, which Spark puts into one task; each becomes all places of an image there."""
    monkeypatch.setattr(graph, "PIXELS", 400)
    m = spark.createDataFrame([(k, 1, 1) for k in range(20)], "page long, y int, x int")
    out = graph.every_place(m, (10, 8))
    shares = out.rdd.glom().map(len).collect()
    assert len(shares) == 4 and sum(shares) == 1600 and max(shares) < 600
    assert sorted(map(tuple, out.collect())) == [(k, y, x) for k in range(20) for y in range(10) for x in range(8)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2
