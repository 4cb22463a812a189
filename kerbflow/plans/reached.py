"""Registered queries of single predicates, aggregates and pictures, over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kerbflow.functions import geometry as G
from kerbflow.operators import boundary, entities, footpath, graph, items, labels, linking, quantities, raster, shapes, spatial, stats
from kerbflow.plans.more import WD, words
from kerbflow.plans.pixels import ML, PL, SIZE, centres, corridor, ml, pl
from kerbflow.plans.queries import DR, FIVE, HIT, MASK, PT, PX, RING, WS, dr, five, hit, pt, px, query, rounded, table, ws
from kerbflow.sources import images, tables

# -- drawings ---------------------------------------------------------------------------

STYLE = "st AS (SELECT *, CASE drawing_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '[] 0' ELSE '[3 2] 0' END AS dashes, CASE WHEN drawing_id % 11 > 0 THEN (drawing_id % 7) / 2.0::DOUBLE END AS width FROM dr)"


def styled(spark, sf):
    k = F.col("drawing_id")
    d = dr(spark, sf).withColumn("dashes", F.when(k % 4 == 1, "[] 0").when(k % 4 > 1, "[3 2] 0"))
    line = F.struct(F.lit("l").alias("op"), F.array("x0", "y0").alias("p0"), F.array("x1", "y1").alias("p1"), F.lit(None).cast("array<double>").alias("rect"))
    box = F.struct(F.lit("re").alias("op"), F.lit(None).cast("array<double>").alias("p0"), F.lit(None).cast("array<double>").alias("p1"), F.array("x0", "y0", "x1", "y1").alias("rect"))
    bend = F.struct(F.lit("c").alias("op"), F.array("x0", "y0").alias("p0"), F.array("x1", "y1").alias("p1"), F.lit(None).cast("array<double>").alias("rect"))
    own = F.filter(F.array(line, F.when(k % 3 > 0, box), F.when(k % 5 == 0, bend)), lambda i: i.isNotNull())
    return d.withColumn("width", F.when(k % 11 > 0, (k % 7) / F.lit(2.0))).withColumn("path_items", own)


@query(f"WITH {DR}, {STYLE} SELECT drawing_id, coalesce(width > 2, false) AS thick FROM st WHERE dashes IS NOT NULL AND dashes <> '[] 0'")
def dashed_strokes(spark, sf):
    return labels.dashed(styled(spark, sf)).select("drawing_id", labels.thick(F.col("width")).alias("thick"))


@query(f"""WITH {DR} SELECT drawing_id, round(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) + CASE WHEN drawing_id % 3 > 0 THEN 2 * (abs(x1 - x0) + abs(y1 - y0)) ELSE 0 END, 6) AS length FROM dr""")
def length_proxy(spark, sf):
    return rounded(styled(spark, sf).select("drawing_id", entities.path_length_proxy(F.col("path_items")).alias("length")), 6)


@query(f"""WITH {DR} SELECT page, drawing_id AS seqno, 0 AS item_no, 'l' AS op, x0 AS first_x FROM dr UNION ALL SELECT page, drawing_id, 1, 're', NULL FROM dr WHERE drawing_id % 3 > 0
UNION ALL SELECT page, drawing_id, CASE WHEN drawing_id % 3 > 0 THEN 2 ELSE 1 END, 'c', x0 FROM dr WHERE drawing_id % 5 = 0""")
def path_item_rows(spark, sf):
    return tables.path_items(styled(spark, sf).withColumnRenamed("drawing_id", "seqno")).select("page", "seqno", "item_no", "op", F.col("p0")[0].alias("first_x"))


@query(f"WITH {DR} SELECT drawing_id, 'l' || CASE WHEN drawing_id % 3 > 0 THEN ',re' ELSE '' END || CASE WHEN drawing_id % 5 = 0 THEN ',c' ELSE '' END AS ops FROM dr WHERE (x1 - x0) * (y1 - y0) < 40")
def small_drawing_ops(spark, sf):
    return items.small_with_ops(styled(spark, sf), 40.0).select("drawing_id", F.array_join("ops", ",").alias("ops"))


@query(f"WITH {DR} SELECT drawing_id, round(least(abs((x0 * 7) % 180 - (y1 * 5) % 180), 180 - abs((x0 * 7) % 180 - (y1 * 5) % 180)), 6) AS degrees FROM dr")
def angle_differences(spark, sf):
    return rounded(dr(spark, sf).select("drawing_id", G.angle_between(F.col("x0") * 7, F.col("y1") * 5).alias("degrees")), 6)


@query(f"WITH {DR} SELECT page, arg_min(drawing_id, (sqrt((x0 - 20) * (x0 - 20) + (y0 - 22.5) * (y0 - 22.5)), drawing_id)) AS nearest FROM dr GROUP BY page")
def closest_drawings(spark, sf):
    return dr(spark, sf).select("page", "drawing_id", F.col("x0").alias("x"), F.col("y0").alias("y")).groupBy("page").agg(spatial.closest_row(dr(spark, sf), 20.0, 22.5, "drawing_id")).select("page", F.col("nearest.drawing_id").alias("nearest"))


@query(f"""WITH {DR}, p AS (SELECT page, count(*) AS n FROM dr GROUP BY page), t AS (SELECT page FROM p ORDER BY n DESC, page LIMIT 1) SELECT drawing_id AS node, page::BIGINT AS component FROM dr JOIN t USING (page)""")
def largest_component(spark, sf):
    return graph.largest_component(dr(spark, sf).select(F.col("drawing_id").alias("node"), F.col("page").cast("long").alias("component"))).select("node", "component")


@query(f"""WITH {DR}, n AS (SELECT drawing_id // 2 AS page, drawing_id AS node, y0 AS y, x0 AS x FROM dr) SELECT page, node, CASE WHEN count(*) OVER (PARTITION BY page) = 2 THEN CASE WHEN row_number() OVER (PARTITION BY page ORDER BY y, x, node) = 1 THEN 'start' ELSE 'end' END END AS role FROM n""")
def start_and_end(spark, sf):
    return graph.start_and_end(dr(spark, sf).select(F.floor(F.col("drawing_id") / 2).alias("page"), F.col("drawing_id").alias("node"), F.col("y0").alias("y"), F.col("x0").alias("x"))).select("page", "node", "role")


@query(f"""WITH {PT}, d AS (SELECT path_id AS page, i AS a, lead(i) OVER w AS b, y AS ay, x AS ax, lead(y) OVER w AS b_y, lead(x) OVER w AS bx FROM pt WINDOW w AS (PARTITION BY path_id ORDER BY i)),
e AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) AS distance FROM d WHERE b IS NOT NULL), f AS (SELECT *, max(distance) OVER (PARTITION BY page) AS most, round(abs(b_y - ay) / (1 + abs(bx - ax)), 9) AS score FROM e)
SELECT page, a, b, score FROM f WHERE distance >= 0.65 * most QUALIFY row_number() OVER (PARTITION BY page ORDER BY score DESC, a, b) = 1""")
def upright_pairs(spark, sf):
    w = Window.partitionBy("path_id").orderBy("i")
    d = pt(spark, sf).select(F.col("path_id").alias("page"), F.col("i").cast("long").alias("a"), F.lead("i").over(w).cast("long").alias("b"), F.col("y").alias("ay"), F.col("x").alias("ax"), F.lead("y").over(w).alias("by"), F.lead("x").over(w).alias("bx")).where("b is not null")
    return rounded(graph.upright_pair(d.withColumn("distance", G.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))), 9)


@query(f"""WITH {DR}, e AS (SELECT page, drawing_id AS a, lead(drawing_id) OVER (PARTITION BY page ORDER BY drawing_id) AS b, x0 AS dist FROM dr) SELECT page, a::INT AS a, b::INT AS b, dist FROM e WHERE b IS NOT NULL""")
def graph_file_edges(spark, sf):
    """Edges gathered into the records of graph files, a page each, and read back from them."""
    e = dr(spark, sf).select("page", F.col("drawing_id").alias("a"), F.lead("drawing_id").over(Window.partitionBy("page").orderBy("drawing_id")).alias("b"), F.col("x0").alias("dist")).where("b is not null")
    files = e.groupBy("page").agg(F.collect_list(F.struct(F.col("page"), F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "dist")).alias("edges"))
    return tables.graph_edges(files).select("page", "a", "b", "dist")


@query(f"""WITH {PT}, s AS (SELECT path_id, i % 2 AS arc, x, y FROM pt), r AS (SELECT path_id, arc, avg(sqrt((x - 50) * (x - 50) + (y - path_id % 90) * (y - path_id % 90))) AS radius FROM s GROUP BY 1, 2)
SELECT path_id, arc, round(radius, 6) AS radius, CASE WHEN row_number() OVER (PARTITION BY path_id ORDER BY radius, arc) = 1 THEN 'inner' ELSE 'outer' END AS side FROM r""")
def arc_choice(spark, sf):
    p = pt(spark, sf)
    c = p.select("path_id").distinct().select("path_id", F.lit(50.0).alias("cx"), (F.col("path_id") % 90).cast("double").alias("cy"))
    return rounded(shapes.arc_sides(p.select("path_id", (F.col("i") % 2).cast("long").alias("arc"), "x", "y"), c), 6)


@query(f"WITH {PT}, {FIVE} SELECT polygon_id, round(min(x), 6) AS x0, round(min(y), 6) AS y0, round(max(x), 6) AS x1, round(max(y), 6) AS y1, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM five GROUP BY polygon_id")
def vertex_means(spark, sf):
    return rounded(shapes.vertex_means(five(spark, sf), "polygon_id"), 6)


@query(f"""WITH {PT}, {WS}, m AS (SELECT path_id, quantile_cont(w, 0.5) AS med, stddev_pop(w) AS sd, count(w) AS n FROM ws GROUP BY path_id) SELECT path_id, i, round(CASE WHEN n < 4 OR w <= med + 2 * sd THEN w END, 6) AS w FROM ws JOIN m USING (path_id)""")
def high_widths_rejected(spark, sf):
    return rounded(stats.without_high_widths(ws(spark, sf)).select("path_id", F.col("i").cast("long").alias("i"), "w"), 6)


@query(f"WITH {PT}, b AS (SELECT path_id, count(*) AS n, max(y) - min(y) AS sy, max(x) - min(x) AS sx FROM pt GROUP BY path_id) SELECT path_id, CASE WHEN n < 3 THEN 'Critique: FAILED. A valid polygon must have at least 3 [y, x] ordered points.' WHEN sy < 80 OR sx < 80 THEN printf('Critique: FAILED. Area is far too small (Vert %.1f, Horiz %.1f). Found a speck instead of a stage.', sy, sx) ELSE printf('Critique: PASS. Geometric spread is validated (Vert %.1f, Horiz %.1f). Proceed to human confirmation!', sy, sx) END AS critique FROM (SELECT path_id, n, floor(sy) + 0.25::DOUBLE AS sy, floor(sx) + 0.75::DOUBLE AS sx FROM b)")
def polygon_critique(spark, sf):
    """Spreads end in quarters, ties of the decimal that is told."""
    p = pt(spark, sf).groupBy("path_id").agg(F.count("*").alias("n"), (F.floor(F.max("y") - F.min("y")) + 0.25).alias("sy"), (F.floor(F.max("x") - F.min("x")) + 0.75).alias("sx"))
    ring = p.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n")))).select("path_id", F.when(F.col("k") == 1, F.col("sx")).otherwise(0.0).alias("x"), F.when(F.col("k") == 1, F.col("sy")).otherwise(0.0).alias("y"))
    return quantities.polygon_critique(ring, "path_id", 80.0)


@query(f"WITH {DR}, {WD} SELECT page, word_no, round_even((y0 + y1) / 2 / 50.0::DOUBLE * 1000, 2) AS ny, round_even((x0 + x1) / 2 / 60.0::DOUBLE * 1000, 2) AS nx FROM wd WHERE text LIKE '%a3%'")
def text_markers(spark, sf):
    w = words(spark, sf)
    return labels.text_markers(w, w.select("page").distinct().withColumn("width", F.lit(60.0)).withColumn("height", F.lit(50.0)), "A3")


@query(f"""WITH {DR}, {WD}, f AS (SELECT * FROM (SELECT page, word_no, x0, y0, x1, y1 FROM wd WHERE word_no % 97 = 4) QUALIFY row_number() OVER (PARTITION BY page ORDER BY word_no) = 1), p AS (SELECT DISTINCT page FROM dr)
SELECT page, round(CASE WHEN word_no IS NULL THEN 0.05::DOUBLE * 60 ELSE greatest(0, x0 - 20) END, 6) AS x0, round(CASE WHEN word_no IS NULL THEN 0.05::DOUBLE * 50 ELSE greatest(0, y0 - 20) END, 6) AS y0, round(CASE WHEN word_no IS NULL THEN 0.45::DOUBLE * 60 ELSE least(60, x1 + 260) END, 6) AS x1, round(CASE WHEN word_no IS NULL THEN 0.55::DOUBLE * 50 ELSE least(50, y1 + 260) END, 6) AS y1 FROM p LEFT JOIN f USING (page)""")
def legend_window(spark, sf):
    w = words(spark, sf)
    text = F.when(F.col("word_no") % 97 == 4, F.concat(F.lit("Legend of "), "text")).otherwise(F.col("text"))
    pages = w.select("page").distinct().withColumn("width", F.lit(60.0)).withColumn("height", F.lit(50.0))
    return rounded(labels.legend_window(w.select("page", F.col("word_no").alias("line_no"), "x0", "y0", "x1", "y1", text.alias("text")), pages), 6)


@query("SELECT doc_id AS conv_id, 0 AS turn, 'tool' AS agent, 'tool' AS task, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '... (truncated)' ELSE text END AS result FROM documents")
def long_tool_results(spark, sf):
    """Documents as what tools return, many of them longer than a log row takes."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("tool").alias("role"), "text")
    return quantities.log_rows(d)


# -- links ------------------------------------------------------------------------------

RADIUS = 6.0
LABELS = "la AS (SELECT page, hit_id AS label_id, x, y, hit_id % 3 AS style, (hit_id % 5) / 4.0::DOUBLE AS keyword FROM hit)"


def hit_labels(spark, sf):
    return hit(spark, sf).select("page", F.col("hit_id").alias("label_id"), "x", "y", (F.col("hit_id") % 3).alias("style"), ((F.col("hit_id") % 5) / F.lit(4.0)).alias("keyword"))


def styled_drawings(spark, sf):
    return dr(spark, sf).select("page", "drawing_id", "x0", "y0", "x1", "y1", (F.col("drawing_id") % 3).alias("style"))


@query(f"""WITH {HIT}, {DR}, {LABELS}, p AS (SELECT la.page, label_id, drawing_id, sqrt((x - (x0 + x1) / 2) * (x - (x0 + x1) / 2) + (y - (y0 + y1) / 2) * (y - (y0 + y1) / 2)) AS distance, (style = drawing_id % 3)::INT AS same, keyword FROM la JOIN dr ON dr.page = la.page AND abs(x - (x0 + x1) / 2) <= {RADIUS} AND abs(y - (y0 + y1) / 2) <= {RADIUS})
SELECT page, label_id, drawing_id, round(distance, 6) AS distance, round(0.5::DOUBLE / (1 + distance / 100.0::DOUBLE) + 0.3::DOUBLE * same + 0.2::DOUBLE * keyword, 6) AS score FROM p WHERE distance <= {RADIUS}""")
def link_scores(spark, sf):
    return rounded(linking.link_scores(hit_labels(spark, sf), styled_drawings(spark, sf), RADIUS), 6)


@query(None)
def weighted_links(spark, sf):
    """Held against the one order of choice in the tests."""
    return rounded(linking.weighted_links(hit_labels(spark, sf), styled_drawings(spark, sf), RADIUS, 0.6), 6)


# -- pixels -----------------------------------------------------------------------------

PIX = "pixel AS (SELECT page, y, x, (page * 7 + y * 31) % 256 AS r, (page + x * 13) % 256 AS g, (y * x * 5) % 256 AS b FROM px)"


@query(f"WITH {PX}, {PIX} SELECT page, y, x FROM pixel WHERE (r - 128) * (r - 128) + (g - 100) * (g - 100) + (b - 60) * (b - 60) <= 8100")
def color_masks(spark, sf):
    c = F.col
    p = px(spark, sf).select("page", "y", "x", ((c("page") * 7 + c("y") * 31) % 256).alias("r"), ((c("page") + c("x") * 13) % 256).alias("g"), ((c("y") * c("x") * 5) % 256).alias("b"))
    return raster.color_mask(p, (128, 100, 60), 90.0)


@query(f"""WITH {PX}, p AS (SELECT DISTINCT page, 1.25 + page % 5 AS x, 0.5 + page % 7 AS y FROM px), c AS (SELECT page, x, y, floor(y)::INT + a.range AS cy, floor(x)::INT + b.range AS cx, CASE a.range WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END * CASE b.range WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END AS share FROM p, range(0, 2) a, range(0, 2) b)
SELECT c.page AS point_id, round(CASE WHEN count(*) = count(px.v) THEN sum(share * px.v) ELSE 1e6 END, 6) AS value FROM c LEFT JOIN px ON px.page = c.page AND px.y = cy AND px.x = cx WHERE share > 0 GROUP BY c.page""")
def bilinear_values(spark, sf):
    f = px(spark, sf)
    p = f.select("page").distinct().select(F.col("page").alias("point_id"), "page", (1.25 + F.col("page") % 5).alias("x"), (0.5 + F.col("page") % 7).alias("y"))
    return rounded(raster.bilinear(p, f), 6)


@query(f"""WITH {PX}, {MASK}, p AS (SELECT DISTINCT page, 2.0::DOUBLE + page % 5 AS x, 3.0::DOUBLE + page % 4 AS y FROM px), n AS (SELECT p.page, m.x::DOUBLE AS nx, m.y::DOUBLE AS ny FROM p JOIN mask m ON m.page = p.page AND abs(m.x - p.x) <= 1 AND abs(m.y - p.y) <= 1
  QUALIFY row_number() OVER (PARTITION BY p.page ORDER BY (m.x - p.x) * (m.x - p.x) + (m.y - p.y) * (m.y - p.y), m.y, m.x) = 1) SELECT p.page AS point_id, coalesce(nx, x) AS x, coalesce(ny, y) AS y, nx IS NOT NULL AS snapped FROM p LEFT JOIN n USING (page)""")
def snapped_points(spark, sf):
    p = px(spark, sf)
    at = p.select("page").distinct().select(F.col("page").alias("point_id"), "page", (2.0 + F.col("page") % 5).alias("x"), (3.0 + F.col("page") % 4).alias("y"))
    return spatial.snapped(at, p.where("v > 0").select("page", "y", "x"), 1).select("point_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "snapped")


ENDS = "(VALUES (0, 63, 0, 0, 7, 7), (7, 56, 0, 7, 7, 0), (3, 59, 0, 3, 7, 3), (24, 31, 3, 0, 3, 7)) e(a, b, ay, ax, b_y, bx)"


@query(f"""WITH {PX}, {MASK}, e AS (SELECT DISTINCT page, a, b, ay, ax, b_y, bx FROM px, {ENDS}), d AS (SELECT page, a, b, round_even(ax + (bx - ax) * (k / 39.0::DOUBLE), 0)::INT AS x, round_even(ay + (b_y - ay) * (k / 39.0::DOUBLE), 0)::INT AS y FROM e, range(0, 40) t(k)),
o AS (SELECT d.page, a, b, avg((mask.page IS NULL)::INT) AS ratio FROM d LEFT JOIN mask USING (page, y, x) GROUP BY ALL)
SELECT page, a, b, round(ratio, 6) AS outside_ratio, round(sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) * (1 + 5 * ratio), 6) AS cost FROM e JOIN o USING (page, a, b) WHERE sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) <= 9""")
def edge_outside_costs(spark, sf):
    p = px(spark, sf)
    ends = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("a", "b", "ay", "ax", "by", "bx"), row)]) for row in ((0, 63, 0, 0, 7, 7), (7, 56, 0, 7, 7, 0), (3, 59, 0, 3, 7, 3), (24, 31, 3, 0, 3, 7))])
    e = p.select("page").distinct().withColumn("e", F.explode(ends)).select("page", "e.*").withColumn("distance", G.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    out = graph.edge_costs(graph.outside_ratio(e, p.where("v > 0").select("page", "y", "x")), 9.0)
    return rounded(out.select("page", "a", "b", "outside_ratio", "cost"), 6)


@query(f"""WITH {PX}, r AS (SELECT page, y, x - row_number() OVER (PARTITION BY page, y ORDER BY x) AS k, x FROM px WHERE v > 0.02), c AS (SELECT page, y * 100 + min(x) AS component, count(*) AS area, max(x) - min(x) + 1 AS w, 1 AS h FROM r GROUP BY page, y, k),
s AS (SELECT *, greatest(w, h) / least(w, h)::DOUBLE AS aspect, area / (w * h)::DOUBLE AS fill FROM c)
SELECT page, component, CASE WHEN area < 2 THEN 'too_small' WHEN area > 5 THEN 'too_large' WHEN aspect < 2.5 AND fill > 0.9 THEN 'blob_like' ELSE 'keep' END AS keep_reason, round(greatest(w, h) * (1 + 0.15::DOUBLE * ln(greatest(area, 2))) - 0.4::DOUBLE * least(w, h), 6) AS score FROM s""")
def component_reasons(spark, sf):
    """Runs of rows as components."""
    run = F.col("x") - F.row_number().over(Window.partitionBy("page", "y").orderBy("x"))
    p = px(spark, sf).where("v > 0.02").withColumn("k", run)
    p = p.withColumn("component", (F.col("y") * 100 + F.min("x").over(Window.partitionBy("page", "y", "k"))).cast("long"))
    s = raster.keep_reason(raster.component_stats(p.select("page", "component", "y", "x")), 2, 5, 2.5, 0.9)
    return rounded(raster.ribbon_score(s).select("page", "component", "keep_reason", "score"), 6)


@query(f"""WITH {PX}, m AS (SELECT page, count(*) AS area_px, count(*) FILTER (WHERE v > 0.1) AS skeleton_px, (max(x) - min(x))::DOUBLE AS width_px FROM px WHERE v > 0 GROUP BY page)
SELECT page, round(skeleton_px * 0.02::DOUBLE, 6) AS skeleton_m, round(skeleton_px / 2.0::DOUBLE * 0.02::DOUBLE, 6) AS outline_m, round(area_px * 0.0004::DOUBLE, 6) AS area_m2, round(CASE WHEN width_px > 0 THEN area_px / width_px * 0.02::DOUBLE END, 6) AS by_width_m FROM m""")
def strip_lengths(spark, sf):
    s = px(spark, sf).where("v > 0").groupBy("page").agg(F.count("*").alias("area_px"), F.count_if(F.col("v") > 0.1).alias("skeleton_px"), (F.max("x") - F.min("x")).cast("double").alias("width_px"))
    return rounded(shapes.measured_lengths(s, 0.02).select("page", "skeleton_m", "outline_m", "area_m2", "by_width_m"), 6)


CROSS = "(VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) c(dy, dx)"


@query(f"""WITH {PX}, k AS (SELECT a.range - 1 AS dy, b.range - 1 AS dx FROM range(0, 3) a, range(0, 3) b), d AS (SELECT DISTINCT page, y + dy AS y, x + dx AS x FROM px, {CROSS} WHERE v > 0.1), l AS (SELECT d.* FROM d JOIN px USING (page, y, x) WHERE px.v > -0.1),
w AS (SELECT DISTINCT page, y + dy AS y, x + dx AS x FROM l, k) SELECT page, (y - dy)::INT AS y, (x - dx)::INT AS x FROM w, k GROUP BY 1, 2, 3 HAVING count(*) = 9""")
def reconstructed_mask(spark, sf):
    p = px(spark, sf)
    return raster.reconstructed(p.where("v > 0.1").select("page", "y", "x"), p.where("v > -0.1").select("page", "y", "x"), 1)


STROKE = """sg AS (SELECT page, x0 AS ax, y0 AS ay, x1 AS bx, y1 AS b_y, greatest((drawing_id % 4) / 2.0::DOUBLE, 1) AS r FROM dr),
sp AS (SELECT *, unnest(range(ceil(least(ay, b_y) - r)::BIGINT, floor(greatest(ay, b_y) + r)::BIGINT + 1)) AS y FROM sg), sq AS (SELECT *, unnest(range(ceil(least(ax, bx) - r)::BIGINT, floor(greatest(ax, bx) + r)::BIGINT + 1)) AS x FROM sp),
su AS (SELECT *, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)))) AS t FROM sq),
tk AS (SELECT DISTINCT page, y::INT AS y, x::INT AS x FROM su WHERE sqrt((x - (ax + t * (bx - ax))) * (x - (ax + t * (bx - ax))) + (y - (ay + t * (b_y - ay))) * (y - (ay + t * (b_y - ay)))) <= r)"""


def strokes(spark, sf):
    return dr(spark, sf).select("page", F.col("x0").alias("ax"), F.col("y0").alias("ay"), F.col("x1").alias("bx"), F.col("y1").alias("by"), (F.col("drawing_id") % 4).cast("double").alias("width"))


@query(f"WITH {DR}, {STROKE} SELECT * FROM tk")
def thick_paths(spark, sf):
    return raster.thick_path(strokes(spark, sf))


@query(f"""WITH {DR}, {STROKE}, {PT}, {FIVE}, {RING}, c AS (SELECT page, polygon_id, k, x + (bx - x) * (k - y) / (b_y - y) AS cut FROM (SELECT *, unnest(range(ceil(least(y, b_y))::BIGINT, ceil(greatest(y, b_y))::BIGINT)) AS k FROM ring)),
s AS (SELECT page, k, cut, lead(cut) OVER w AS stop, row_number() OVER w AS n FROM c WINDOW w AS (PARTITION BY polygon_id, k ORDER BY cut)),
b AS (SELECT page, unnest(range(round_even(y0, 0)::INT, round_even(y1, 0)::INT + 1))::INT AS y, round_even(x0, 0)::INT AS a, round_even(x1, 0)::INT AS z FROM dr)
SELECT * FROM tk UNION SELECT page, y, unnest(range(a, z + 1))::INT FROM b UNION SELECT page, k::INT, unnest(range(ceil(cut)::BIGINT, floor(stop)::BIGINT + 1))::INT FROM s WHERE n % 2 = 1 AND stop IS NOT NULL""")
def drawn_pixels(spark, sf):
    """Filled polygons, boxes and strokes in one mask."""
    return raster.drawn_pixels(five(spark, sf), dr(spark, sf), strokes(spark, sf))


@query(f"WITH {PL}, {ML} SELECT page, y, x, 255 AS v FROM ml")
def mask_files(spark, sf):
    """Masks as PNG files, one a page, and read back from their bytes."""
    return images.mask_pixels(images.mask_files(ml(spark, sf), SIZE), "page")


@query(None)
def absorbed_fragments(spark, sf):
    """Runs of rows as fragments, by number; held against a plain version in the tests."""
    return raster.touching_absorbed(fragments(spark, sf), 1)


def fragments(spark, sf):
    run = F.col("x") - F.row_number().over(Window.partitionBy("page", "y").orderBy("x"))
    p = pl(spark, sf).where("v > 0.14").withColumn("k", run)
    order = Window.partitionBy("page").orderBy("y", "k")
    return p.select(F.col("page").cast("int").alias("page"), F.dense_rank().over(order).alias("component"), "y", "x")


@query(None)
def ends_extended(spark, sf):
    """Held against a plain version in the tests."""
    return rounded(boundary.ends_extended(centres(spark, sf).where("i between 3 and 6"), corridor(spark, sf), 2), 6)


# -- bars and images --------------------------------------------------------------------


@query(f"""WITH {PT}, a AS (SELECT path_id, i, abs(x) / 2 AS d_pos, y / 3 AS d_neg, (i * 7 + path_id) % 6 > 0 AS valid FROM pt), n AS (SELECT path_id, count(*) AS n, greatest(1, count(*) // 20) AS stride, avg(d_pos + d_neg) FILTER (WHERE valid) AS mu, stddev_pop(d_pos + d_neg) FILTER (WHERE valid) AS sd FROM a GROUP BY path_id),
t AS (SELECT DISTINCT path_id, i, least(greatest(i + round_even(-stride + 2.0::DOUBLE * stride * k / 9, 0)::INT, 0), n - 1) AS j FROM a JOIN n USING (path_id), range(0, 10) r(k) WHERE i % stride = 0),
m AS (SELECT t.path_id, t.i, quantile_cont(a.d_pos, 0.5) AS p, quantile_cont(a.d_neg, 0.5) AS q, count(*) AS c FROM t JOIN a ON a.path_id = t.path_id AND a.i = t.j WHERE a.valid GROUP BY 1, 2)
SELECT path_id, i, round(p, 6) AS med_pos, round(q, 6) AS med_neg, round(p + q, 6) AS width, CASE WHEN sd < 1e-6 OR abs(p + q - mu) / sd <= 1 THEN 'green' WHEN abs(p + q - mu) / sd <= 2 THEN 'yellow' ELSE 'red' END AS class, c AS n FROM m JOIN n USING (path_id)""")
def width_bars(spark, sf):
    p = pt(spark, sf).select("path_id", F.col("i").cast("long").alias("i"), (F.abs("x") / 2).alias("d_pos"), (F.col("y") / 3).alias("d_neg"), ((F.col("i") * 7 + F.col("path_id")) % 6 > 0).alias("valid"))
    return rounded(footpath.median_bars(p.withColumn("w", F.col("d_pos") + F.col("d_neg")), 20), 6)


@query(f"WITH {DR} SELECT page, drawing_id AS xref FROM dr WHERE x1 >= 24 - page % 7 AND x0 <= 36 - page % 7 AND y1 >= 16 AND y0 <= 28")
def images_near(spark, sf):
    """Boxes as embedded images, around a centre a page."""
    d = dr(spark, sf)
    centres = d.select("page").distinct().select("page", (30.0 - F.col("page") % 7).alias("x"), F.lit(22.0).alias("y"))
    return items.images_near(d.select("page", F.col("drawing_id").alias("xref"), F.array("x0", "y0", "x1", "y1").alias("rect")), centres, 6.0).select("page", "xref")
