"""Further registered queries: labels, legends, shapes, masks and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.operators import curves, graph, labels, raster, shapes
from kerbflow.plans.queries import DR, FIVE, MASK, PT, PX, RING, _tangents, dr, five, mask, page_edges, pt, px, query, rounded, table

WD = """wd AS (SELECT page, drawing_id AS word_no, x0, y0, x1, y1, lower(CASE drawing_id % 5 WHEN 0 THEN 'scale' WHEN 1 THEN 'a3' WHEN 2 THEN ((drawing_id % 6) * 5)::VARCHAR WHEN 3 THEN name ELSE kind END) AS text FROM dr)"""
LN = "ln AS (SELECT page, word_no AS line_no, x0, y0, x1, y1, CASE WHEN word_no % 97 = 4 THEN 'Legend of ' || text ELSE text END AS text FROM wd)"


def words(spark, sf) -> DataFrame:
    k = F.col("drawing_id") % 5
    text = F.when(k == 0, "scale").when(k == 1, "a3").when(k == 2, ((F.col("drawing_id") % 6) * 5).cast("string")).when(k == 3, F.col("name")).otherwise(F.col("kind"))
    return dr(spark, sf).select("page", F.col("drawing_id").alias("word_no"), "x0", "y0", "x1", "y1", F.lower(text).alias("text"))


def lines(spark, sf) -> DataFrame:
    text = F.when(F.col("word_no") % 97 == 4, F.concat(F.lit("Legend of "), "text")).otherwise(F.col("text"))
    return words(spark, sf).select("page", F.col("word_no").alias("line_no"), "x0", "y0", "x1", "y1", text.alias("text"))


@query(rf"WITH {DR}, {WD}, {LN} SELECT line_no FROM ln WHERE regexp_matches(lower(text), 'scale|\b\d+\s*:\s*\d+\b|\bnts\b')")
def scale_candidates(spark, sf):
    return labels.scale_candidates(lines(spark, sf)).select("line_no")


@query(f"WITH {DR} SELECT drawing_id, x0 >= 10 AND y0 >= 18 AND x1 <= 40 AND y1 <= 26 AS inside FROM dr WHERE x1 >= 10 AND x0 <= 40 AND y1 >= 18 AND y0 <= 26")
def region_filters(spark, sf):
    box = (10.0, 18.0, 40.0, 26.0)
    d = dr(spark, sf)
    return labels.touching(d, box).select("drawing_id").join(labels.inside(d, box).select("drawing_id", F.lit(True).alias("inside")), "drawing_id", "left").select("drawing_id", F.coalesce("inside", F.lit(False)).alias("inside"))


@query(f"""WITH {DR}, d AS (SELECT drawing_id, sqrt((fill[1]-0.5)^2+(fill[2]-0.5)^2+(fill[3]-1)^2) AS f, sqrt((stroke[1]-0.5)^2+(stroke[2]-0.5)^2+(stroke[3]-1)^2) AS s FROM dr)
SELECT drawing_id, CASE WHEN f <= 0.6 THEN 'fill' ELSE 'stroke' END AS channel, round(CASE WHEN f <= 0.6 THEN f ELSE s END, 4) AS match_distance FROM d WHERE f <= 0.6 OR coalesce(s <= 0.6, false)""")
def color_match(spark, sf):
    return rounded(labels.color_match(dr(spark, sf), [0.5, 0.5, 1.0], 0.6, True).select("drawing_id", "channel", "match_distance"))


@query(f"""WITH {DR}, f AS (SELECT * FROM dr WHERE x1 >= 5 AND x0 <= 45 AND y1 >= 18 AND y0 <= 30 AND x1 - x0 >= 5 AND y1 - y0 >= 1 AND (x1 - x0) / greatest(y1 - y0, 0.1) >= 2)
SELECT drawing_id FROM f QUALIFY row_number() OVER (PARTITION BY page, round(x0, 1), round(y0, 1), round(x1, 1), round(y1, 1) ORDER BY drawing_id) = 1""")
def bar_rectangles(spark, sf):
    return labels.bar_rectangles(dr(spark, sf), (5.0, 18.0, 45.0, 30.0)).select("drawing_id")


@query(f"WITH {DR} SELECT page, count(*) FILTER (WHERE (x1-x0)*(y1-y0) <= 30) AS kept, count(*) FILTER (WHERE (x1-x0)*(y1-y0) > 30) AS skipped FROM dr GROUP BY page")
def area_share(spark, sf):
    return labels.under_area_share(dr(spark, sf), 300.0, 0.1)


@query(f"WITH {DR} SELECT drawing_id, coalesce(stroke[1] + stroke[2] + stroke[3] < 0.1, false) AS black_stroke FROM dr WHERE fill[1] + fill[2] + fill[3] = 0 AND (x1-x0)*(y1-y0) > 5 AND (x1-x0)*(y1-y0) < 100")
def dark_dashes(spark, sf):
    return labels.dark_dashes(dr(spark, sf)).select("drawing_id", labels.is_black(F.col("stroke")).alias("black_stroke"))


REGION = f"""{DR}, {WD}, {LN}, fl AS (SELECT * FROM ln WHERE regexp_matches(lower(text), '\\blegend\\b') QUALIFY row_number() OVER (PARTITION BY page ORDER BY line_no) = 1),
pg AS (SELECT DISTINCT page, 60.0::DOUBLE AS width, 50.0::DOUBLE AS height FROM dr),
rg AS (SELECT pg.page, CASE WHEN fl.x0 IS NOT NULL THEN greatest(fl.x0 - 12, 0) ELSE 0.60 * width END AS x0, CASE WHEN fl.y0 IS NOT NULL THEN greatest(fl.y0 - 12, 0) ELSE 0.55 * height END AS y0, least(coalesce(fl.x1 + 12, 0.98 * width), width) AS x1, least(coalesce(fl.y1 + 12, 0.98 * height), height) AS y1 FROM pg LEFT JOIN fl USING (page))"""


def regions(spark, sf):
    pages = dr(spark, sf).select("page").distinct().withColumn("width", F.lit(60.0)).withColumn("height", F.lit(50.0))
    return labels.legend_region(lines(spark, sf), pages)


@query(f"WITH {REGION} SELECT page, round(x0, 4) AS x0, round(y0, 4) AS y0, round(x1, 4) AS x1, round(y1, 4) AS y1 FROM rg")
def legend_region(spark, sf):
    return rounded(regions(spark, sf))


@query(f"""WITH {REGION} SELECT line_no, CASE WHEN text LIKE '%scale%' THEN 'scale' ELSE 'sheet' END AS feature_type FROM ln JOIN rg USING (page)
WHERE ln.x1 >= rg.x0 AND ln.x0 <= rg.x1 AND ln.y1 >= rg.y0 AND ln.y0 <= rg.y1 AND (lower(text) LIKE '%scale%' OR lower(text) LIKE '%a3%')""")
def legend_entries(spark, sf):
    return labels.legend_entries(lines(spark, sf), regions(spark, sf), (("scale", ("scale",)), ("sheet", ("a3",)))).select("line_no", "feature_type")


@query(f"WITH {DR} SELECT page, round(min(x0) - 2, 4) AS x0, round(min(y0) - 2, 4) AS y0, round(max(x1) + 2, 4) AS x1, round(max(y1) + 2, 4) AS y1 FROM dr GROUP BY page")
def envelope(spark, sf):
    return rounded(labels.envelope(dr(spark, sf), "page", 2.0))


@query(f"""WITH {DR}, {WD}, c AS (SELECT a.page, a.word_no AS left_no, b.word_no AS right_no, b.x0 - a.x1 AS gap FROM wd a JOIN wd b ON a.page = b.page AND a.text = 'a3' AND b.text = 'scale' AND abs(a.y0 - b.y0) <= 0.5 AND b.x0 >= a.x1)
SELECT page, left_no, right_no, round(gap, 4) AS gap FROM c QUALIFY row_number() OVER (PARTITION BY page, left_no ORDER BY gap, right_no) = 1""")
def token_pairs(spark, sf):
    return rounded(labels.token_pairs(words(spark, sf), "a3", "scale", 0.5))


@query(rf"""WITH {DR}, {WD}, t AS (SELECT page, word_no, text::DOUBLE AS value, (x0 + x1) / 2 AS cx, y0 FROM wd WHERE regexp_full_match(text, '\d+(\.\d+)?')), l AS (SELECT DISTINCT page FROM wd)
SELECT page, value, cx AS x FROM t JOIN l USING (page) WHERE cx >= 12 AND abs(y0 - 20) <= 6 QUALIFY row_number() OVER (PARTITION BY page, value ORDER BY word_no) = 1""")
def scale_ticks(spark, sf):
    w = words(spark, sf)
    return labels.ticks_right_of(w, w.select("page").distinct().withColumn("x", F.lit(12.0)).withColumn("y", F.lit(20.0)), 6.0)


@query(f"WITH {DR}, {WD} SELECT page, (x0 + x1) / 2 AS x, round((y0 + y1) / 2, 4) AS y FROM wd WHERE text LIKE '%a3%' QUALIFY row_number() OVER (PARTITION BY page ORDER BY word_no DESC) = 1")
def text_centre(spark, sf):
    return rounded(labels.text_centre(words(spark, sf), "A3"))


@query(r"""SELECT page_id, CASE WHEN lower(url) LIKE '%.pdf' THEN 'application/pdf' WHEN lower(url) LIKE '%.png' THEN 'image/png' WHEN lower(url) LIKE '%.jpg' OR lower(url) LIKE '%.jpeg' THEN 'image/jpeg' ELSE 'application/octet-stream' END AS media_type,
  CASE WHEN replace(url, '\', '/') LIKE '/%' THEN replace(url, '\', '/') ELSE '/' || replace(url, '\', '/') END AS path FROM pages""")
def file_fields(spark, sf):
    return table(spark, sf, "pages").select("page_id", labels.media_type(F.col("url")).alias("media_type"), labels.rooted(F.col("url")).alias("path"))


@query("""WITH e AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS a, list_sort(list_distinct(list(event_type) FILTER (WHERE value > 150))) AS c FROM events GROUP BY user_id),
s AS (SELECT user_id, list_filter(a, lambda x: list_contains(coalesce(c, []), x)) AS yes, list_filter(a, lambda x: NOT list_contains(coalesce(c, []), x)) AS no FROM e)
SELECT user_id, concat_ws('; ', CASE WHEN len(yes) > 0 THEN 'Confirmed: ' || array_to_string(yes, ', ') END, CASE WHEN len(no) > 0 THEN 'Not confirmed: ' || array_to_string(no, ', ') END) AS summary FROM s""")
def confirmations(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("a"), F.sort_array(F.collect_set(F.when(F.col("value") > 150, F.col("event_type")))).alias("c"))
    return e.select("user_id", labels.confirmation(F.col("a"), F.col("c")).alias("summary"))


# -- shapes -----------------------------------------------------------------------------


@query(f"""WITH {PT}, m AS (SELECT path_id, avg(x) AS mx, avg(y) AS my, atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) / 2 AS angle FROM pt GROUP BY path_id),
p AS (SELECT path_id, x, y, round((x - mx) * cos(angle) + (y - my) * sin(angle), 9) AS t FROM pt JOIN m USING (path_id)),
a AS (SELECT path_id, x AS ax, y AS ay FROM p QUALIFY row_number() OVER (PARTITION BY path_id ORDER BY t, y, x) = 1), b AS (SELECT path_id, x AS bx, y AS b_y FROM p QUALIFY row_number() OVER (PARTITION BY path_id ORDER BY t DESC, y, x) = 1)
SELECT path_id, ax, ay, bx, b_y FROM a JOIN b USING (path_id)""")
def axis_ends(spark, sf):
    return shapes.axis_ends(pt(spark, sf), "path_id")


@query(f"""WITH {PT}, {FIVE}, c AS (SELECT a.polygon_id, a.i AS p0, b.i AS p1, round(sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)), 9) AS d, b.x - a.x AS dx, b.y - a.y AS dy FROM five a JOIN five b ON a.polygon_id = b.polygon_id AND a.i < b.i),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY polygon_id ORDER BY d DESC, p0, p1) = 1)
SELECT polygon_id, round(CASE WHEN g < 0 THEN g + 180 WHEN g >= 180 THEN g - 180 ELSE g END, 4) AS angle FROM (SELECT polygon_id, degrees(atan2(dy, dx)) AS g FROM f)""")
def dash_directions(spark, sf):
    return rounded(shapes.dash_directions(five(spark, sf), "polygon_id"))


@query(None)
def collinear_groups(spark, sf):
    d = shapes.dash_directions(five(spark, sf), "polygon_id").join(five(spark, sf).groupBy("page", "polygon_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")), "polygon_id")
    return shapes.collinear_groups(d.select("page", F.col("polygon_id").cast("long").alias("dash_id"), "cx", "cy", "angle"))


@query(None)
def polygon_simplify(spark, sf):
    return rounded(shapes.simplified(pt(spark, sf), "path_id", 0.01))


@query(f"""WITH {PT}, {FIVE}, {RING},
h AS (SELECT polygon_id, count(*) FILTER (WHERE (y > 4.85) <> (b_y > 4.85) AND x + (4.85 - y) * (bx - x) / nullif(b_y - y, 0) > 2.75) AS hits, abs(sum(x * b_y - bx * y)) / 2 AS area FROM ring GROUP BY polygon_id)
SELECT polygon_id, round(area, 4) AS area FROM h WHERE hits % 2 = 1 AND area > 1 ORDER BY area, polygon_id LIMIT 1""")
def tightest_polygon(spark, sf):
    return rounded(shapes.containing(five(spark, sf), 2.75, 4.85, "polygon_id", 1.0))


@query(f"WITH {PT} SELECT path_id, i, round(5 + 2 * (x - 5) * cos(radians(30.0)) - 2 * (y - 6) * sin(radians(30.0)) + 1, 4) AS x, round(6 + 2 * (x - 5) * sin(radians(30.0)) + 2 * (y - 6) * cos(radians(30.0)) - 1, 4) AS y FROM pt")
def affine(spark, sf):
    return rounded(shapes.transformed(pt(spark, sf), 2.0, 1.0, -1.0, 5.0, 6.0, 30.0).select("path_id", F.col("i").cast("long").alias("i"), "x", "y"))


def _trim(t: str, name: str) -> str:
    """SQL of a curve table without the hook at its start (reach 400, 80 degrees, two points ahead)."""
    return f"""{name}_d AS (SELECT path_id, i, x, y, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS step, x - first(x) OVER e AS ax, y - first(y) OVER e AS ay, coalesce(lead(x, 2) OVER w, last(x) OVER e) - x AS bx, coalesce(lead(y, 2) OVER w, last(y) OVER e) - y AS b_y, count(*) OVER e AS n
  FROM {t} WINDOW w AS (PARTITION BY path_id ORDER BY i), e AS (PARTITION BY path_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
{name}_c AS (SELECT *, sum(step) OVER (PARTITION BY path_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS d FROM {name}_d),
{name}_m AS (SELECT path_id, max(d) AS total, least(count(*) FILTER (WHERE d <= 400), max(n) - 4) AS most FROM {name}_c GROUP BY path_id),
{name}_f AS (SELECT path_id, max(i) AS cut FROM {name}_c JOIN {name}_m USING (path_id) WHERE n >= 8 AND total > 400 AND most >= 3 AND i BETWEEN 2 AND most AND sqrt(ax*ax+ay*ay) >= 1e-6 AND sqrt(bx*bx+b_y*b_y) >= 1e-6
  AND acos(greatest(-1, least(1, (ax*bx+ay*b_y) / (sqrt(ax*ax+ay*ay) * sqrt(bx*bx+b_y*b_y))))) >= radians(80) GROUP BY path_id),
{name} AS (SELECT path_id, i - coalesce(cut, 0) AS i, x, y FROM {t} LEFT JOIN {name}_f USING (path_id) WHERE cut IS NULL OR i >= cut)"""


@query(f"""WITH {PT}, {_trim('pt', 'one')}, turned AS (SELECT path_id, max(i) OVER (PARTITION BY path_id) - i AS i, x, y FROM one), {_trim('turned', 'two')}
SELECT path_id, max(i) OVER (PARTITION BY path_id) - i AS i, x, y FROM two""")
def hooks_trimmed(spark, sf):
    return shapes.hooks_trimmed(pt(spark, sf).withColumn("i", F.col("i").cast("long")), 80.0, 400.0, 2)


@query(f"""WITH {PT}, t AS {_tangents(3)}, g AS (SELECT *, max(tx) FILTER (WHERE i = 2) OVER w AS hx, max(ty) FILTER (WHERE i = 2) OVER w AS hy, max(tx) FILTER (WHERE i = n - 3) OVER w AS ex, max(ty) FILTER (WHERE i = n - 3) OVER w AS ey FROM t WINDOW w AS (PARTITION BY path_id)),
u AS (SELECT path_id, i, x, y, CASE WHEN n <= 4 THEN tx WHEN i < 2 THEN hx WHEN i > n - 3 THEN ex ELSE tx END AS tx, CASE WHEN n <= 4 THEN ty WHEN i < 2 THEN hy WHEN i > n - 3 THEN ey ELSE ty END AS ty FROM g)
SELECT path_id, i, round(tx, 4) + 0.0 AS tx, round(ty, 4) + 0.0 AS ty FROM u""")
def guarded_tangents(spark, sf):
    out = rounded(curves.guard_end_tangents(curves.tangents(pt(spark, sf), 3), 2))
    return out.select("path_id", F.col("i").cast("long").alias("i"), (F.col("tx") + 0.0).alias("tx"), (F.col("ty") + 0.0).alias("ty"))


# -- masks and paths --------------------------------------------------------------------


@query(f"""WITH {PX} SELECT page, CASE WHEN v > 0.1 THEN 0.35 WHEN v > 0 THEN 1.2 ELSE 8.0 END::DOUBLE AS cost, count(*) AS n FROM px GROUP BY 1, 2""")
def cost_map(spark, sf):
    p = px(spark, sf)
    return raster.cost_map(p, p.where("v > 0"), p.where("v > 0.1")).groupBy("page", "cost").agg(F.count("*").alias("n"))


def _labelled(p: DataFrame) -> DataFrame:
    """Components by four neighbours, named by the number of their first pixel among all pages' 64."""
    c = F.col("component")
    place = F.floor(c % 1_000_000_000_000 / 1_000_000) * 8 + c % 1_000_000
    return graph.labelled(p, 4).select("page", "y", "x", (F.col("page") * 64 + place).cast("long").alias("component"))


HOLES = f"""{PX}, bg AS (SELECT page, y, x, page * 64 + y * 8 + x AS node FROM px WHERE v <= 0.02), e AS (SELECT a.node AS a, b.node AS b FROM bg a JOIN bg b ON a.page = b.page AND abs(a.y - b.y) + abs(a.x - b.x) <= 1),
r(a, b) AS (SELECT node, node FROM bg UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), c AS (SELECT a AS node, min(b) AS component FROM r GROUP BY a), lb AS (SELECT bg.page, y, x, component FROM bg JOIN c USING (node))"""


@query(f"WITH RECURSIVE {HOLES} SELECT page, y, x FROM lb WHERE (page, component) NOT IN (SELECT page, component FROM lb WHERE y IN (0, 7) OR x IN (0, 7))")
def enclosed_holes(spark, sf):
    return raster.enclosed(_labelled(px(spark, sf).where("v <= 0.02")), (8, 8)).select("page", "y", "x")


@query(f"WITH RECURSIVE {HOLES} SELECT page, y, x FROM lb WHERE (page, component) IN (SELECT page, component FROM lb GROUP BY 1, 2 HAVING count(*) >= 6)")
def small_removed(spark, sf):
    return raster.small_removed(_labelled(px(spark, sf).where("v <= 0.02")), 6).select("page", "y", "x")


@query(f"WITH RECURSIVE {HOLES} SELECT page, y, x FROM lb WHERE (page, component) IN (SELECT page, component FROM lb WHERE y = 3 AND x = 3)")
def flood_fill(spark, sf):
    p = px(spark, sf).where("v <= 0.02")
    return graph.flooded(p, p.where("y = 3 and x = 3"))


@query(f"""WITH {PX}, m AS (SELECT page, y, x FROM px WHERE v > 0), d AS (SELECT vec_id AS ray_id, vec_id AS page, 2 AS y, k AS x FROM embeddings, (SELECT unnest(range(1, 7)) AS k))
SELECT ray_id, round(avg(CASE WHEN m.page IS NULL THEN 0.0 ELSE 1.0 END), 4) AS support FROM d LEFT JOIN m USING (page, y, x) GROUP BY ray_id""")
def support_ratio(spark, sf):
    rays = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ray_id"), F.col("vec_id").alias("page"), F.lit(0.0).alias("x"), F.lit(2.0).alias("y"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"))
    return rounded(raster.support_ratio(rays, mask(spark, sf), 1, 6))


@query(None)
def grid_paths(spark, sf):
    p = px(spark, sf).withColumn("page", F.col("page").cast("int"))
    costs = raster.cost_map(p, p.where("v > 0"), p.where("v > 0.1"))
    ends = costs.select("page").distinct().withColumn("ay", F.lit(0)).withColumn("ax", F.lit(0)).withColumn("by", F.lit(7)).withColumn("bx", F.lit(7))
    return rounded(graph.grid_paths(costs, ends))


@query(None)
def branches_pruned(spark, sf):
    return graph.branches_pruned(page_edges(spark, sf), 2)


@query(None)
def ends_clipped(spark, sf):
    return rounded(graph.ends_clipped(page_edges(spark, sf), 2.0))


@query(f"""WITH {PX}, {MASK}, d AS (SELECT vec_id AS ray_id, k FROM embeddings JOIN (SELECT unnest(range(0, 9)) AS k) ON true JOIN mask m ON m.page = vec_id AND m.y = 2 AND m.x = k),
g AS (SELECT ray_id, min(k) AS k FROM (SELECT *, k - row_number() OVER (PARTITION BY ray_id ORDER BY k) AS g FROM d) GROUP BY ray_id, g HAVING count(*) >= 2), f AS (SELECT ray_id, min(k)::DOUBLE AS distance FROM g GROUP BY ray_id)
SELECT vec_id AS ray_id, distance FROM embeddings LEFT JOIN f ON ray_id = vec_id""")
def first_black(spark, sf):
    rays = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ray_id"), F.col("vec_id").alias("page"), F.lit(0.0).alias("x"), F.lit(2.0).alias("y"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"))
    return raster.first_black(rays, mask(spark, sf), 1.0, 8.0, 2)


@query(None)
def outlines(spark, sf):
    return raster.contours(_labelled(px(spark, sf).where("v > 0.02")))


@query(f"""WITH RECURSIVE {PX}, {MASK}, g AS (SELECT page, y, x, x - row_number() OVER (PARTITION BY page, y ORDER BY x) AS k FROM mask), n AS (SELECT page, y, min(x) AS a, max(x) AS b, dense_rank() OVER (PARTITION BY page ORDER BY y) - 1 AS i FROM g GROUP BY page, y, k),
r(page, i, y, a, b) AS (SELECT page, i, any_value(y), arg_min(a, (a - b, a)), arg_min(b, (a - b, a)) FROM n WHERE i = 0 GROUP BY page, i UNION ALL
  SELECT n.page, n.i, any_value(n.y), arg_min(n.a, (abs((n.a + n.b) / 2.0::DOUBLE - (r.a + r.b) / 2.0::DOUBLE), n.a - n.b, n.a)), arg_min(n.b, (abs((n.a + n.b) / 2.0::DOUBLE - (r.a + r.b) / 2.0::DOUBLE), n.a - n.b, n.a)) FROM r JOIN n ON n.page = r.page AND n.i = r.i + 1 GROUP BY n.page, n.i)
SELECT page, y, (a + b) / 2.0::DOUBLE AS x, a AS first, b AS last FROM r""")
def row_centres(spark, sf):
    return curves.row_centres(curves.row_runs(mask(spark, sf), ["page", "y"]))


@query(f"""WITH {PT}, t AS {_tangents(1)}, s AS (SELECT path_id, i, sum(tx) OVER w - tx AS sx, sum(ty) OVER w - ty AS sy FROM t WINDOW w AS (PARTITION BY path_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT path_id, i, round(CASE WHEN sqrt(sx*sx+sy*sy) < 1e-9 THEN 0 ELSE sx / sqrt(sx*sx+sy*sy) END, 4) + 0.0 AS mx, round(CASE WHEN sqrt(sx*sx+sy*sy) < 1e-9 THEN 0 ELSE sy / sqrt(sx*sx+sy*sy) END, 4) + 0.0 AS my FROM s""")
def neighbour_means(spark, sf):
    out = rounded(curves.neighbour_means(curves.tangents(pt(spark, sf)), 3))
    return out.select("path_id", F.col("i").cast("long").alias("i"), (F.col("mx") + 0.0).alias("mx"), (F.col("my") + 0.0).alias("my"))


@query(f"""WITH {PT}, l AS (SELECT path_id, i, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(i) OVER w AS n FROM pt WINDOW w AS (PARTITION BY path_id ORDER BY i)), e AS (SELECT *, sqrt((x-px)*(x-px)+(y-py)*(y-py)) AS s FROM l WHERE n IS NULL AND px IS NOT NULL)
SELECT path_id, i, round(x, 4) AS x, round(y, 4) AS y FROM pt UNION ALL SELECT path_id, i + 1, round(x + (x - px) / s * 7, 4), round(y + (y - py) / s * 7, 4) FROM e WHERE s > 0""")
def end_extension(spark, sf):
    p = pt(spark, sf).withColumn("i", F.col("i").cast("long"))
    return rounded(curves.extended(p, p.select("path_id").distinct().withColumn("distance", F.lit(7.0))))
