"""Registered queries: path items, visibility, scale bars, rays to boundaries, stations, bends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbflow.functions import geometry as G
from kerbflow.operators import curves, graph, items, labels, raster, shapes
from kerbflow.plans.more import WD, words
from kerbflow.plans.queries import ARC, DR, PT, PX, RAYS, SEG, STEP, dr, mask, pt, px, query, rounded, table

#: Every drawing as an item of an array of four: lines, curves and boxes in turn.
IT = """it AS (SELECT page, drawing_id // 4 AS drawing_id, drawing_id % 4 AS item_no, CASE drawing_id % 3 WHEN 0 THEN 'l' WHEN 1 THEN 'c' ELSE 're' END AS op, x0 AS ax, y0 AS ay, x1 AS bx, y1 AS b_y,
  CASE WHEN drawing_id % 3 = 1 THEN x0 + 2 END AS c1x, CASE WHEN drawing_id % 3 = 1 THEN y1 + 1 END AS c1y, CASE WHEN drawing_id % 3 = 1 THEN x1 - 2 END AS c2x, CASE WHEN drawing_id % 3 = 1 THEN y0 - 1 END AS c2y FROM dr)"""
SPOT = "sp AS (SELECT n_nationkey AS point_id, (n_nationkey % 4)::INT AS page, n_nationkey * 2.0::DOUBLE AS x, 18.0::DOUBLE + n_nationkey % 7 * 2 AS y FROM nation)"


def path_items(spark, sf) -> DataFrame:
    d, k = dr(spark, sf), F.col("drawing_id")
    curve = lambda v: F.when(k % 3 == 1, v)
    c = F.col
    return d.select(
        "page", F.floor(k / 4).alias("drawing_id"), (k % 4).alias("item_no"), F.when(k % 3 == 0, "l").when(k % 3 == 1, "c").otherwise("re").alias("op"),
        c("x0").alias("ax"), c("y0").alias("ay"), c("x1").alias("bx"), c("y1").alias("by"),
        curve(c("x0") + 2).alias("c1x"), curve(c("y1") + 1).alias("c1y"), curve(c("x1") - 2).alias("c2x"), curve(c("y0") - 1).alias("c2y"),
    )


def spots(spark, sf) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(k.alias("point_id"), (k % 4).cast("int").alias("page"), (k * F.lit(2.0)).alias("x"), (18.0 + k % 7 * 2).alias("y"))


BEZ = "(1-t)*(1-t)*(1-t)*a{c} + 3*(1-t)*(1-t)*t*c1{c} + 3*(1-t)*t*t*c2{c} + t*t*t*b{c}"
BX, BY = BEZ.format(c="x"), "(1-t)*(1-t)*(1-t)*ay + 3*(1-t)*(1-t)*t*c1y + 3*(1-t)*t*t*c2y + t*t*t*b_y"


@query(f"""WITH {DR}, {IT}, w AS (SELECT *, lag(bx) OVER o AS px, lag(b_y) OVER o AS py FROM it WHERE op <> 're' WINDOW o AS (PARTITION BY drawing_id ORDER BY item_no)),
k AS (SELECT *, k / (CASE op WHEN 'c' THEN 8 ELSE 1 END)::DOUBLE AS t FROM (SELECT *, unnest(range(CASE WHEN coalesce(sqrt((ax-px)*(ax-px)+(ay-py)*(ay-py)) <= 1e-6, false) THEN 1 ELSE 0 END, CASE op WHEN 'c' THEN 9 ELSE 2 END)) AS k FROM w))
SELECT drawing_id, row_number() OVER (PARTITION BY drawing_id ORDER BY item_no, k) - 1 AS i, round(CASE WHEN op = 'c' THEN {BX} WHEN k = 0 THEN ax ELSE bx END, 6) AS x, round(CASE WHEN op = 'c' THEN {BY} WHEN k = 0 THEN ay ELSE b_y END, 6) AS y FROM k""")
def path_chain(spark, sf):
    return rounded(items.chained(path_items(spark, sf), 8).withColumn("i", F.col("i").cast("long")), 6)


NEAR = f"""{DR}, {IT}, {SPOT}, m AS (SELECT it.*, point_id, x, y FROM it JOIN sp USING (page)),
q AS (SELECT *, greatest(0, least(1, ((x-ax)*(bx-ax)+(y-ay)*(b_y-ay)) / ((bx-ax)*(bx-ax)+(b_y-ay)*(b_y-ay)))) AS s FROM m),
cu AS (SELECT point_id, drawing_id, item_no, min(sqrt((x - ({BX}))*(x - ({BX})) + (y - ({BY}))*(y - ({BY})))) AS distance FROM (SELECT *, k / 100.0::DOUBLE AS t FROM (SELECT *, unnest(range(0, 101)) AS k FROM m WHERE op = 'c')) GROUP BY 1, 2, 3),
h AS (SELECT point_id, drawing_id, item_no, sqrt((ax+s*(bx-ax)-x)*(ax+s*(bx-ax)-x) + (ay+s*(b_y-ay)-y)*(ay+s*(b_y-ay)-y)) AS distance FROM q WHERE op = 'l' UNION ALL SELECT * FROM cu
  UNION ALL SELECT point_id, drawing_id, item_no, sqrt(greatest(ax-x, 0, x-bx)*greatest(ax-x, 0, x-bx) + greatest(ay-y, 0, y-b_y)*greatest(ay-y, 0, y-b_y)) FROM q WHERE op = 're'), ht AS (SELECT * FROM h WHERE distance <= 3)"""


@query(f"WITH {NEAR} SELECT point_id, drawing_id, item_no, round(distance, 6) AS distance FROM ht")
def items_within(spark, sf):
    return rounded(items.items_within(path_items(spark, sf), spots(spark, sf), 3.0), 6)


@query(f"WITH {NEAR} SELECT drawing_id, item_no, op FROM it WHERE drawing_id IN (SELECT drawing_id FROM ht)")
def whole_drawings(spark, sf):
    every = path_items(spark, sf)
    return items.whole_drawings(every, items.items_within(every, spots(spark, sf), 3.0)).select("drawing_id", "item_no", "op")


PIX = "pb AS (SELECT * FROM (SELECT drawing_id, page, least(greatest(round_even(x0 * 2, 0)::INT, 0), 100) AS px0, least(greatest(round_even(y0 * 2, 0)::INT, 0), 80) AS py0, least(greatest(round_even(x1 * 2, 0)::INT, 0), 100) AS px1, least(greatest(round_even(y1 * 2, 0)::INT, 0), 80) AS py1 FROM dr) WHERE px1 > px0 AND py1 > py0)"


@query(f"""WITH {DR}, {PIX}, dot AS (SELECT DISTINCT (o_custkey * 4 // 150)::INT AS page, (36 + o_orderkey % 44)::INT AS y, (o_orderkey * 7 % 100)::INT AS x FROM orders),
n AS (SELECT drawing_id, count(*) AS n FROM pb JOIN dot ON pb.page = dot.page AND dot.x >= px0 AND dot.x < px1 AND dot.y >= py0 AND dot.y < py1 GROUP BY drawing_id),
r AS (SELECT pb.*, coalesce(n, 0) AS visible_pixels, coalesce(n, 0) / ((px1 - px0) * (py1 - py0))::DOUBLE AS visible_ratio FROM pb LEFT JOIN n USING (drawing_id))
SELECT drawing_id, px0, py0, px1, py1, visible_pixels, round(visible_ratio, 6) AS visible_ratio, CASE WHEN visible_ratio >= 0.01 AND visible_pixels >= 2 THEN 'visible' ELSE 'hidden_or_occluded' END AS visibility FROM r""")
def visibility(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    dots = o.select(F.floor(F.col("o_custkey") * 4 / 150).cast("int").alias("page"), (36 + k % 44).cast("int").alias("y"), (k * 7 % 100).cast("int").alias("x"))
    out = items.visibility(items.pixel_boxes(dr(spark, sf), 2.0, 2.0, 100, 80), dots, 0.01, 2)
    return rounded(out.select("drawing_id", "px0", "py0", "px1", "py1", "visible_pixels", "visible_ratio", "visibility"), 6)


@query(f"WITH {DR} SELECT page, drawing_id, x0, y0, x1, y1 FROM dr WHERE page = 1 AND x1 > x0 AND y1 > y0")
def redaction_rects(spark, sf):
    return items.redaction_rects(dr(spark, sf), 1)


@query(f"""WITH {DR}, s AS (SELECT page, min(x0) - 0 AS bx0, min(y0) AS by0, max(x1) AS bx1, max(y1) AS by1 FROM dr WHERE x0 < 20 GROUP BY page), r AS (SELECT DISTINCT page, 5.0::DOUBLE AS rx0, 6.0::DOUBLE AS ry0, 30.0::DOUBLE AS rx1, 40.0::DOUBLE AS ry1 FROM dr)
SELECT page, greatest(0, round_even(coalesce(bx0, rx0) * 2, 0)::INT - 3) AS x0, greatest(0, round_even(coalesce(by0, ry0) * 2, 0)::INT - 3) AS y0, least(90, round_even(coalesce(bx1, rx1) * 2, 0)::INT + 3) AS x1, least(80, round_even(coalesce(by1, ry1) * 2, 0)::INT + 3) AS y1 FROM r LEFT JOIN s USING (page)""")
def exclusion_rects(spark, sf):
    d = dr(spark, sf)
    regions = d.select("page").distinct().withColumns({"x0": F.lit(5.0), "y0": F.lit(6.0), "x1": F.lit(30.0), "y1": F.lit(40.0)})
    return labels.exclusion_rects(d.where("x0 < 20"), regions, 2.0, 3, 90, 80)


@query(f"WITH {DR} SELECT upper(name) AS label, fill AS color FROM dr WHERE drawing_id = (SELECT min(drawing_id) FROM dr WHERE upper(name) = (SELECT upper(name) FROM dr ORDER BY drawing_id LIMIT 1))")
def target_color(spark, sf):
    """Entries with blanks around their labels and in lower case; the label that is asked for is the first drawing's name."""
    d = dr(spark, sf)
    entries = d.select(F.concat(F.lit("  "), F.lower("name"), F.lit(" ")).alias("label"), F.lit("ok").alias("status"), F.col("fill").alias("color"), F.col("drawing_id").alias("entry_no"))
    wanted = d.agg(F.min_by("name", "drawing_id")).first()[0]
    return labels.target_color(entries, f" {wanted.lower()} ").select(G.normal_label(F.col("label")).alias("label"), "color")


PAIR = f"""{DR}, {WD}, pc AS (SELECT a.page, b.x0 - a.x0 AS gap, a.word_no AS left_no, b.word_no AS right_no, least(a.x0, b.x0) AS x0, least(a.y0, b.y0) AS y0, greatest(a.x1, b.x1) AS x1, greatest(a.y1, b.y1) AS y1, (a.y0 + b.y0) / 2 AS anchor_y, b.x1 AS ratio_x1
  FROM wd a JOIN wd b ON a.page = b.page AND a.text = 'a3' AND b.text = 'scale' AND abs(a.y0 - b.y0) <= 5 AND b.x0 >= a.x0), bp AS (SELECT * FROM pc QUALIFY row_number() OVER (PARTITION BY page ORDER BY gap, left_no, right_no) = 1)"""


@query(f"WITH {PAIR} SELECT page, left_no, right_no, x0, y0, x1, y1 FROM bp")
def best_pair(spark, sf):
    return labels.best_pair(words(spark, sf)).select("page", "left_no", "right_no", "x0", "y0", "x1", "y1")


@query(rf"""WITH {PAIR}, m AS (SELECT bp.page, word_no, text, wd.x0 - ratio_x1 AS gap FROM bp JOIN wd ON bp.page = wd.page AND regexp_full_match(text, '\d{{2,5}}') AND abs(wd.y0 - anchor_y) <= 8 AND wd.x0 - ratio_x1 BETWEEN 0 AND 40)
SELECT page, word_no AS ratio_no, text::INT AS ratio FROM m QUALIFY row_number() OVER (PARTITION BY page ORDER BY gap, word_no) = 1""")
def ratio_values(spark, sf):
    w = words(spark, sf)
    return labels.ratio_values(labels.best_pair(w), w)


@query(f"""WITH {PAIR}, t AS (SELECT page, min(x0) - 2 AS a, min(y0) - 2 AS b, max(x1) + 2 AS c, max(y1) + 2 AS d FROM wd WHERE text IN ('0', '5', '10', '20', '25', '50') AND x0 > 30 GROUP BY page)
SELECT page, CASE WHEN a IS NULL THEN x1 + 4 ELSE greatest(0, least(x0, a) - 2) END AS x0, CASE WHEN a IS NULL THEN y0 - 6 ELSE greatest(0, least(y0, b) - 6) END AS y0, CASE WHEN a IS NULL THEN x1 + 220 ELSE greatest(x1, c) + 2 END AS x1, CASE WHEN a IS NULL THEN y1 + 14 ELSE greatest(y1, d) + 14 END AS y1 FROM bp LEFT JOIN t USING (page)""")
def search_boxes(spark, sf):
    w = words(spark, sf)
    ticks = labels.envelope(w.where(F.col("text").isin("0", "5", "10", "20", "25", "50") & (F.col("x0") > 30)), "page", 2.0)
    return labels.search_boxes(labels.best_pair(w), ticks)


@query(f"""WITH {DR} SELECT drawing_id, round(0.5::DOUBLE * (0.176::DOUBLE / ((x1 - x0) * 3 / (x1 - x0)) + 0.176::DOUBLE / ((y1 - y0) * 4 / (y1 - y0))), 9) AS by_size, round(0.176::DOUBLE / (x1 - x0), 9) AS by_density, round(25.4::DOUBLE / 220 * (drawing_id + 100) / 1000.0::DOUBLE, 9) AS by_ratio FROM dr""")
def metres_per_pixel(spark, sf):
    c, w, h = F.col, F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    d = dr(spark, sf)
    out = labels.checked_calibration(d.select(c("drawing_id").alias("page"), w.alias("w"), h.alias("h")), d.select(c("drawing_id").alias("page"), (c("drawing_id") + 100).alias("ratio")), 220)
    m = F.lit(0.176)
    return rounded(out.select(c("page").alias("drawing_id"), labels.metres_per_pixel(m, c("w") * 3, c("h") * 4, c("w"), c("h")).alias("by_size"), labels.metres_by_density(m, c("w")).alias("by_density"), c("ratio_m_per_px").alias("by_ratio")), 9)


@query(r"""SELECT event_id, try_cast(event_type AS DOUBLE) AS none, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events""")
def parsed_numbers(spark, sf):
    return table(spark, sf, "events").select("event_id", labels.number(F.col("event_type")).alias("none"), labels.number(F.get_json_object("props", "$.k")).alias("k"))


# -- stations and bends -----------------------------------------------------------------


@query(f"""WITH {PT}, {STEP}, {ARC}, {SEG}, tt AS (SELECT path_id, max(d1) AS total FROM seg GROUP BY path_id),
k AS (SELECT path_id, unnest(range(0, ceil(total / 25)::BIGINT)) * 25.0::DOUBLE AS d FROM tt), e AS (SELECT path_id, d FROM k UNION ALL SELECT path_id, total FROM tt WHERE total - (ceil(total / 25) - 1) * 25.0::DOUBLE > 1e-6),
m AS (SELECT e.path_id, e.d, seg.* EXCLUDE (path_id), row_number() OVER (PARTITION BY e.path_id, e.d ORDER BY d1) AS r FROM e JOIN seg ON seg.path_id = e.path_id AND seg.d0 <= e.d AND e.d <= seg.d1)
SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY d) - 1 AS station, round(d, 6) AS d, round(ax + (bx - ax) * (d - d0) / (d1 - d0), 6) AS x, round(ay + (b_y - ay) * (d - d0) / (d1 - d0), 6) AS y, bx - ax AS tx, b_y - ay AS ty FROM m WHERE r = 1""")
def stations_with_end(spark, sf):
    out = curves.stations_with_end(pt(spark, sf), 25.0)
    return out.select("path_id", F.col("station").cast("long").alias("station"), *[F.round(c, 6).alias(c) for c in ("d", "x", "y")], "tx", "ty")


@query(f"WITH {PT} SELECT path_id, i FROM pt WHERE i % 8 = 0 OR i = (SELECT max(i) FROM pt q WHERE q.path_id = pt.path_id)")
def every_nth(spark, sf):
    return curves.every_nth(pt(spark, sf), 8).select("path_id", F.col("i").cast("long").alias("i"))


CIRC = """mm AS (SELECT path_id, side, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM {t} GROUP BY 1, 2), uu AS (SELECT path_id, side, mx, my, n, x - mx AS u, y - my AS v FROM {t} JOIN mm USING (path_id, side)),
ss AS (SELECT path_id, side, mx, my, n, sum(u*u) AS suu, sum(v*v) AS svv, sum(u*v) AS suv, sum(u*u*u) AS suuu, sum(v*v*v) AS svvv, sum(u*v*v) AS suvv, sum(v*u*u) AS svuu FROM uu GROUP BY ALL),
dd AS (SELECT *, CASE WHEN abs(suu*svv - suv*suv) > 1e-9 THEN suu*svv - suv*suv END AS det FROM ss), cc AS (SELECT *, ((suuu+suvv)/2*svv - (svvv+svuu)/2*suv) / det AS cu, ((svvv+svuu)/2*suu - (suuu+suvv)/2*suv) / det AS cv FROM dd),
ci AS (SELECT path_id, side, n, mx + cu AS cx, my + cv AS cy, sqrt(cu*cu + cv*cv + (suu+svv)/n) AS radius FROM cc)"""
BEND = """tc AS (SELECT path_id, i, count(*) OVER (PARTITION BY path_id) AS n, x - lag(x, 3) OVER w AS ax, y - lag(y, 3) OVER w AS ay, lead(x, 3) OVER w - x AS bx, lead(y, 3) OVER w - y AS b_y FROM pt WINDOW w AS (PARTITION BY path_id ORDER BY i)),
tn AS (SELECT path_id, i, n, round(abs(atan2(ax*b_y - ay*bx, ax*bx + ay*b_y)), 9) AS turn FROM tc), bd AS (SELECT path_id, (CASE WHEN turn IS NULL THEN n // 2 ELSE i END) AS bend_i FROM tn QUALIFY row_number() OVER (PARTITION BY path_id ORDER BY turn DESC NULLS LAST, i) = 1)"""


@query(f"""WITH {PT}, {BEND}, nr AS (SELECT path_id, 0 AS side, x, y FROM pt JOIN bd USING (path_id) WHERE abs(i - bend_i) <= 6), {CIRC.format(t='nr')}, me AS (SELECT path_id, avg(x) AS mx, avg(y) AS my FROM pt GROUP BY path_id)
SELECT path_id, round(CASE WHEN n >= 10 AND radius > 1e-6 THEN cx ELSE me.mx END, 4) AS cx, round(CASE WHEN n >= 10 AND radius > 1e-6 THEN cy ELSE me.my END, 4) AS cy FROM me LEFT JOIN ci USING (path_id)""")
def origins(spark, sf):
    return rounded(curves.origins(pt(spark, sf), 6, 3))


@query(f"""WITH {PT}, h AS (SELECT path_id, i % 2 AS side, x * (1 + i % 2) AS x, y FROM pt), {CIRC.format(t='h')}, b AS (SELECT path_id, 2 * min(radius) AS a, 2 * max(radius) AS c FROM ci WHERE n >= 20 AND radius IS NOT NULL GROUP BY path_id HAVING count(*) = 2)
SELECT path_id, round(a, 4) AS inner_diameter_px, round(c, 4) AS outer_diameter_px, round(a * 0.05::DOUBLE, 4) AS inner_diameter_m, round(c * 0.05::DOUBLE, 4) AS outer_diameter_m FROM b""")
def bend_diameters(spark, sf):
    h = pt(spark, sf).select("path_id", (F.col("i") % 2).alias("side"), (F.col("x") * (1 + F.col("i") % 2)).alias("x"), "y")
    return rounded(curves.bend_diameters(h, 0.05))


@query(f"""WITH {PT}, h AS (SELECT path_id, i, x, y, 1 + i % 3 AS vx, 2 - i % 5 AS vy, count(*) OVER (PARTITION BY path_id) AS n FROM pt), u AS (SELECT *, greatest(2, least(6, n - 2)) AS k, vx / sqrt(vx*vx+vy*vy) AS ux, vy / sqrt(vx*vx+vy*vy) AS uy FROM h WHERE n >= 4),
a AS (SELECT path_id, 0::BIGINT AS i, sum(ux) AS sx, sum(uy) AS sy FROM u WHERE i BETWEEN 1 AND k GROUP BY path_id), b AS (SELECT path_id, max(n) - 1 AS i, sum(ux) AS sx, sum(uy) AS sy FROM u WHERE i BETWEEN n - 1 - k AND n - 2 GROUP BY path_id)
SELECT path_id, i, x, y, round(sx / sqrt(sx*sx+sy*sy), 6) AS dx, round(sy / sqrt(sx*sx+sy*sy), 6) AS dy FROM (SELECT * FROM a UNION ALL SELECT * FROM b) JOIN pt USING (path_id, i)""")
def end_directions(spark, sf):
    i = F.col("i").cast("long")
    h = pt(spark, sf).select("path_id", i.alias("i"), "x", "y", (F.col("x") + 1 + i % 3).alias("hx"), (F.col("y") + 2 - i % 5).alias("hy"))
    out = curves.end_directions(h)
    return out.select("path_id", "i", "x", "y", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"))


# -- rays and components ----------------------------------------------------------------

WALK = f"""{PX}, {RAYS}, sup AS (SELECT page, y, x FROM px WHERE v > -0.1), blk AS (SELECT page, y, x FROM px WHERE v > 0.15),
d AS (SELECT ray_id, page, n, 0.5::DOUBLE + n * 0.5::DOUBLE AS t, round_even(y + dy * (0.5::DOUBLE + n * 0.5::DOUBLE), 0)::INT AS y, round_even(x + dx * (0.5::DOUBLE + n * 0.5::DOUBLE), 0)::INT AS x FROM (SELECT *, unnest(range(0, 24)) AS n FROM ray)),
f AS (SELECT ray_id, n, t, d.y BETWEEN 0 AND 7 AND d.x BETWEEN 0 AND 7 AS inside, sup.page IS NOT NULL AS held, blk.page IS NOT NULL AS black FROM d LEFT JOIN sup USING (page, y, x) LEFT JOIN blk USING (page, y, x)),
g AS (SELECT *, coalesce(max(CASE WHEN NOT black THEN n END) OVER w, -1) + 1 AS bf, coalesce(max(CASE WHEN held THEN n END) OVER w, -1) + 1 AS xf FROM f WINDOW w AS (PARTITION BY ray_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
e AS (SELECT ray_id, min(n) FILTER (WHERE NOT inside) AS leave, min(n) FILTER (WHERE black AND n - bf >= 1) AS hit, min(n) FILTER (WHERE NOT held AND n - xf >= 1) AS outn, max(n) AS last, avg((held AND NOT black)::INT) FILTER (WHERE inside) AS support FROM g GROUP BY ray_id),
e2 AS (SELECT e.*, a.bf AS hit_at, b.xf AS out_at FROM e LEFT JOIN g a ON a.ray_id = e.ray_id AND a.n = e.hit LEFT JOIN g b ON b.ray_id = e.ray_id AND b.n = e.outn)"""


@query(f"""WITH {WALK}, s AS (SELECT *, CASE WHEN outn IS NOT NULL AND greatest(outn, out_at + 4) <= last THEN greatest(outn, out_at + 4) END AS stop FROM e2), z AS (SELECT s.*, g.black AS ab, g.bf AS af FROM s JOIN g ON g.ray_id = s.ray_id AND g.n = coalesce(stop, last))
SELECT ray_id, 0.5::DOUBLE + 0.5::DOUBLE * CASE WHEN leave IS NOT NULL AND leave <= coalesce(hit, leave) AND leave <= coalesce(stop, leave) THEN leave WHEN hit IS NOT NULL AND hit <= coalesce(stop, hit) THEN hit_at WHEN ab THEN af ELSE out_at END AS distance FROM z""")
def rays_to_black(spark, sf):
    p = px(spark, sf)
    return raster.rays_to_black(rays(spark, sf), p.where("v > -0.1"), p.where("v > 0.15"), (8, 8), 12.0, 0.5, 2, 2, 2.0)


def rays(spark, sf) -> DataFrame:
    r = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ray_id"), F.col("vec_id").alias("page"), F.lit(3.0).alias("x"), F.lit(3.0).alias("y"))
    m = F.col("ray_id") % 3
    return r.withColumn("dx", F.when(m == 0, 1.0).when(m == 1, 0.6).otherwise(0.0)).withColumn("dy", F.when(m == 0, 0.0).when(m == 1, 0.8).otherwise(1.0))


@query(f"""WITH {WALK} SELECT ray_id, 0.5::DOUBLE + 0.5::DOUBLE * CASE WHEN leave IS NOT NULL AND leave <= coalesce(hit, leave) AND leave <= coalesce(outn, leave) THEN leave WHEN hit IS NOT NULL AND hit <= coalesce(outn, hit) THEN hit_at ELSE out_at END AS distance, round(coalesce(support, 0), 6) AS support FROM e2""")
def boundary_in_window(spark, sf):
    p = px(spark, sf)
    return rounded(raster.boundary_in_window(rays(spark, sf), p.where("v > -0.1"), p.where("v > 0.15"), (8, 8), F.lit(0.0), F.lit(12.0), 0.5, 2, 2), 6)


TALL = "tall AS (SELECT page // 4 AS page, (page % 4 * 8 + y)::INT AS y, x FROM px WHERE v > 0)"


@query(f"""WITH RECURSIVE {PX}, {TALL}, g AS (SELECT page, y, x, x - row_number() OVER (PARTITION BY page, y ORDER BY x) AS k FROM tall), n AS (SELECT page, y, min(x) AS a, max(x) AS b, dense_rank() OVER (PARTITION BY page ORDER BY y) - 1 AS i FROM g GROUP BY page, y, k),
r(page, i, y, a, b) AS (SELECT page, i, any_value(y), arg_min(a, (a - b, a)), arg_min(b, (a - b, a)) FROM n WHERE i = 0 GROUP BY page, i UNION ALL
  SELECT n.page, n.i, any_value(n.y), arg_min(n.a, (abs((n.a + n.b) / 2.0::DOUBLE - (r.a + r.b) / 2.0::DOUBLE), n.a - n.b, n.a)), arg_min(n.b, (abs((n.a + n.b) / 2.0::DOUBLE - (r.a + r.b) / 2.0::DOUBLE), n.a - n.b, n.a)) FROM r JOIN n ON n.page = r.page AND n.i = r.i + 1 GROUP BY n.page, n.i),
q AS (SELECT *, (a + b) / 2.0::DOUBLE AS c, count(*) OVER (PARTITION BY page) AS m FROM r), f AS (SELECT *, sum(c) OVER (PARTITION BY page ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS s, first(c) OVER e AS c0, last(c) OVER e AS c1 FROM q WINDOW e AS (PARTITION BY page ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT page, i, y, round(greatest(least(CASE WHEN m < 9 THEN c ELSE (s + greatest(0, 4 - i) * c0 + greatest(0, 4 - (m - 1 - i)) * c1) / 9 END, b), a), 4) AS x FROM f""")
def centre_path(spark, sf):
    p = px(spark, sf).where("v > 0")
    tall = p.select(F.floor(F.col("page") / 4).alias("page"), (F.col("page") % 4 * 8 + F.col("y")).cast("int").alias("y"), "x")
    return rounded(curves.centre_path(curves.row_runs(tall, ["page", "y"])).withColumn("i", F.col("i").cast("long")))


@query(None)
def closest_components(spark, sf):
    """Held against a plain version in the tests."""
    p = px(spark, sf).where("v > 0.05")
    node = lambda y, x: (F.col("page") * 64 + F.col(y) * 8 + F.col(x)).cast("long")
    named = p.select("page", "y", "x", node("y", "x").alias("node"))
    e = graph.pixel_graph(p).select(node("ay", "ax").alias("a"), node("by", "bx").alias("b"))
    labelled = named.join(graph.connected_components(named.select("node"), e), "node").select("page", "y", "x", "component")
    return rounded(items.closest_later(items.component_ends(labelled, 2)))


@query(None)
def smallest_rectangles(spark, sf):
    """Held against a plain version in the tests."""
    p = px(spark, sf).where("v > 0.05").select("page", "y", "x")
    return rounded(shapes.smallest_rectangles(graph.labelled(p), "component"))


@query(None)
def largest_filled(spark, sf):
    """Held against a plain version in the tests."""
    return raster.largest_filled(mask(spark, sf), 1, (8, 8))


@query("""WITH c AS (SELECT c_custkey AS id, (c_custkey * 37 % 256)::INT AS r, (c_custkey * 101 % 256)::INT AS g, (c_custkey * 59 % 256)::INT AS b FROM customer), m AS (SELECT *, greatest(r, g, b) AS v, least(r, g, b) AS lo FROM c),
t AS (SELECT *, CASE WHEN v = lo THEN 0 WHEN v = r THEN 60.0::DOUBLE * (g - b) / (v - lo) WHEN v = g THEN 120 + 60.0::DOUBLE * (b - r) / (v - lo) ELSE 240 + 60.0::DOUBLE * (r - g) / (v - lo) END AS deg FROM m),
h AS (SELECT id, v, (round_even((CASE WHEN deg < 0 THEN deg + 360 ELSE deg END) / 2, 0)::INT) % 180 AS h, CASE WHEN v = 0 THEN 0 ELSE round_even(255.0::DOUBLE * (v - lo) / v, 0)::INT END AS s FROM t)
SELECT id, h, s, v, s <= 20 AND v >= 90 AS gray, h BETWEEN 35 AND 95 AND s >= 55 AND v >= 35 AS green, v >= 55 AS non_black, v <= 45 AS black FROM h""")
def hsv_kinds(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(k.alias("id"), *[(k * n % 256).cast("int").alias(c) for n, c in ((37, "r"), (101, "g"), (59, "b"))])
    h, s, v = G.hsv(F.col("r"), F.col("g"), F.col("b"))
    c = c.select("id", h.cast("int").alias("h"), s.alias("s"), v.alias("v"))
    return c.select("*", *[e.alias(n) for n, e in G.hsv_kinds(F.col("h"), F.col("s"), F.col("v")).items()])
