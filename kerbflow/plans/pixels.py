"""Registered queries of isolines, skeletons, tiles, outlines and boundaries, over pages of 32 by 32 pixels.

A page is made of sixteen vectors of the driver's embeddings, four by four blocks of eight by eight values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbflow.operators import boundary, footpath, isolines, raster, spatial, stats, tiles
from kerbflow.plans.queries import PX, px, query, rounded, table

SIZE = (32, 32)
PL = """pl AS (SELECT (vec_id // 16)::BIGINT AS page, ((vec_id % 16) // 4 * 8 + (p - 1) // 8)::INT AS y, (vec_id % 4 * 8 + (p - 1) % 8)::INT AS x, embedding[p]::DOUBLE AS v
  FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS p FROM embeddings))"""
ML = "ml AS (SELECT page, y, x FROM pl WHERE v > -0.1)"
#: What is not set: inside the image, and in a frame around it.
FRAME = "frame AS (SELECT page, a.range - 1 AS y, b.range - 1 AS x FROM (SELECT DISTINCT page FROM pl), range(0, 34) a, range(0, 34) b)"
OFF = f"{FRAME}, off AS (SELECT * FROM frame ANTI JOIN ml USING (page, y, x) WHERE y BETWEEN 0 AND 31 AND x BETWEEN 0 AND 31)"


def pl(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("k"), F.posexplode("embedding").alias("p", "v")).where("p < 64")
    y, x = F.floor(F.col("k") % 16 / 4) * 8 + F.floor(F.col("p") / 8), F.col("k") % 4 * 8 + F.col("p") % 8
    return e.select(F.floor(F.col("k") / 16).alias("page"), y.cast("int").alias("y"), x.cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def ml(spark, sf) -> DataFrame:
    return pl(spark, sf).where("v > -0.1").select("page", "y", "x")


def corridor(spark, sf) -> DataFrame:
    """A band around a slanted line, its edges made rough by the values."""
    return pl(spark, sf).where("abs(x - (12 + y / 4.0)) <= 6 + 12 * v").select("page", "y", "x")


def centres(spark, sf) -> DataFrame:
    p = pl(spark, sf).select("page").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("y", (2 + 3 * F.col("i")).cast("double"))
    return p.select(F.col("page").alias("path_id"), "i", "page", (12 + F.col("y") / 4).alias("x"), "y")


@query(f"""WITH RECURSIVE {PX}, c AS (SELECT a.page, a.y, a.x, [a.v, b.v, d.v, e.v] AS v FROM px a JOIN px b ON b.page = a.page AND b.y = a.y AND b.x = a.x + 1 JOIN px d ON d.page = a.page AND d.y = a.y + 1 AND d.x = a.x + 1 JOIN px e ON e.page = a.page AND e.y = a.y + 1 AND e.x = a.x),
h AS (SELECT *, list_transform(v, lambda z: z > 0.05) AS up, [page * 2000000000000 + (y * 1000000 + x) * 2, page * 2000000000000 + (y * 1000000 + x + 1) * 2 + 1, page * 2000000000000 + ((y + 1) * 1000000 + x) * 2, page * 2000000000000 + (y * 1000000 + x) * 2 + 1] AS e FROM c),
s AS MATERIALIZED (SELECT page, e[k + 1] AS a, CASE WHEN NOT up[(k + 2) % 4 + 1] THEN e[(k + 1) % 4 + 1] WHEN NOT up[(k + 3) % 4 + 1] THEN e[(k + 2) % 4 + 1] ELSE e[(k + 3) % 4 + 1] END AS b FROM h, range(0, 4) t(k) WHERE NOT up[k + 1] AND up[(k + 1) % 4 + 1]),
w(page, line, i, node) AS (SELECT page, a, 0::BIGINT, a FROM s WHERE a NOT IN (SELECT b FROM s) UNION ALL SELECT w.page, w.line, w.i + 1, s.b FROM w JOIN s ON s.a = w.node),
o AS (SELECT * FROM s WHERE a NOT IN (SELECT node FROM w)), r(a, b) AS (SELECT a, b FROM o UNION SELECT r.a, o.b FROM r JOIN o ON o.a = r.b), m AS (SELECT a, min(b) AS line FROM r GROUP BY a),
l(page, line, i, node) AS (SELECT page, a, 0::BIGINT, a FROM o JOIN m USING (a) WHERE m.line = a UNION ALL SELECT l.page, l.line, l.i + 1, o.b FROM l JOIN o ON o.a = l.node WHERE NOT (l.node = l.line AND l.i > 0)),
z AS (SELECT *, false AS closed FROM w UNION ALL SELECT *, true FROM l),
d AS (SELECT DISTINCT a.page, a.page * 2000000000000 + (a.y * 1000000 + a.x) * 2 AS node, a.y::DOUBLE AS y, a.x + (0.05 - a.v) / (b.v - a.v) AS x FROM px a JOIN px b ON b.page = a.page AND b.y = a.y AND b.x = a.x + 1 WHERE (a.v > 0.05) <> (b.v > 0.05)
  UNION ALL SELECT DISTINCT a.page, a.page * 2000000000000 + (a.y * 1000000 + a.x) * 2 + 1, a.y + (0.05 - a.v) / (b.v - a.v), a.x::DOUBLE FROM px a JOIN px b ON b.page = a.page AND b.y = a.y + 1 AND b.x = a.x WHERE (a.v > 0.05) <> (b.v > 0.05))
SELECT z.page, line, i, round(d.y, 6) AS y, round(d.x, 6) AS x, closed FROM z JOIN d ON d.node = z.node""")
def isoline(spark, sf):
    return rounded(isolines.isolines(px(spark, sf), 0.05), 6)


@query(f"WITH {PL}, {ML}, {FRAME}, o AS (SELECT * FROM frame ANTI JOIN ml USING (page, y, x)) SELECT m.page, m.y, m.x, round(min(sqrt((m.y - o.y) * (m.y - o.y) + (m.x - o.x) * (m.x - o.x))), 6) AS v FROM ml m JOIN o ON o.page = m.page GROUP BY ALL")
def banded_distances(spark, sf):
    return rounded(tiles.distances(ml(spark, sf), band=8), 6)


@query(f"WITH {PL}, {ML}, {OFF} SELECT m.page, m.y, m.x, round(min(sqrt((m.y - o.y) * (m.y - o.y) + (m.x - o.x) * (m.x - o.x))), 6) AS v FROM ml m JOIN off o ON o.page = m.page GROUP BY ALL")
def distances_inside(spark, sf):
    return rounded(tiles.distances(ml(spark, sf), SIZE, 8), 6)


@query(f"""WITH {PL}, {ML}, {OFF}, d AS (SELECT m.page, m.y, m.x, min(abs(m.y - o.y) + abs(m.x - o.x)) AS v FROM ml m JOIN off o ON o.page = m.page GROUP BY ALL)
SELECT page, y, x FROM d WHERE v >= ALL (SELECT n.v FROM d n WHERE n.page = d.page AND abs(n.y - d.y) + abs(n.x - d.x) = 1)""")
def morphological_skeleton(spark, sf):
    return tiles.opening_residues(ml(spark, sf), SIZE)


def _relaxed(rounds: int) -> str:
    """SQL that hands the least way to all neighbours, so many times; the pages are narrower."""
    steps = ["k0 AS (SELECT page, node0 AS node, 0.0::DOUBLE AS v FROM s)"]
    for k in range(rounds):
        steps.append(f"k{k + 1} AS MATERIALIZED (SELECT page, node, min(v) AS v FROM (SELECT * FROM k{k} UNION ALL SELECT n.page, n.b, k.v + n.c FROM k{k} k JOIN n ON n.page = k.page AND n.a = k.node) GROUP BY page, node)")
    return ", ".join(steps)


def _jumped(rounds: int) -> str:
    """SQL that names the components of edges e (a, b) over nodes q: the least label next to any node of a label, then that label's own."""
    steps = ["j0 AS (SELECT node, node AS c FROM q)"]
    for k in range(rounds):
        steps.append(f"h{k} AS MATERIALIZED (SELECT i.node, any_value(i.c) AS was, min(j.c) AS c FROM e JOIN j{k} i ON i.node = e.a JOIN j{k} j ON j.node = e.b GROUP BY i.node)")
        steps.append(f"g{k} AS MATERIALIZED (SELECT node, g.c FROM h{k} JOIN (SELECT was, min(c) AS c FROM h{k} GROUP BY was) g USING (was))")
        steps.append(f"j{k + 1} AS MATERIALIZED (SELECT a.node, least(a.c, b.c) AS c FROM g{k} a JOIN g{k} b ON b.node = a.c)")
    return ", ".join(steps)


@query(None)
def medial_axis(spark, sf):
    """Held against the one order of removal in the tests."""
    return rounded(tiles.medial_axis(ml(spark, sf), 16))


@query(None)
def thinned_by_tiles(spark, sf):
    """Held against thinning in one task in the tests."""
    return tiles.thinned(ml(spark, sf), 16, 4)


@query(f"""WITH RECURSIVE {PL}, q AS (SELECT page, y, x FROM pl WHERE v > 0.1), o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, x) AS n FROM q),
r(page, n, taken) AS (SELECT page, 1::BIGINT, [[y, x]] FROM o WHERE n = 1 UNION ALL SELECT o.page, o.n, CASE WHEN len(list_filter(taken, lambda t: (t[1] - o.y) * (t[1] - o.y) + (t[2] - o.x) * (t[2] - o.x) <= 9)) = 0 THEN list_append(taken, [o.y, o.x]) ELSE taken END FROM r JOIN o ON o.page = r.page AND o.n = r.n + 1),
f AS (SELECT page, arg_max(taken, n) AS taken FROM r GROUP BY page)
SELECT page, (k - 1)::BIGINT AS seed, taken[k][1]::INT AS y, taken[k][2]::INT AS x FROM (SELECT *, unnest(range(1, len(taken) + 1)) AS k FROM f)""")
def seeds_by_tiles(spark, sf):
    return tiles.disc_seeds(pl(spark, sf).where("v > 0.1"), 3, 16)


@query(f"""WITH RECURSIVE {PL}, {ML}, s AS (SELECT page, min(y * 32 + x) AS node0 FROM ml GROUP BY page), n AS (SELECT a.page, a.y * 32 + a.x AS a, b.y * 32 + b.x AS b, sqrt(abs(a.y - b.y) + abs(a.x - b.x)) AS c FROM ml a JOIN ml b ON a.page = b.page AND greatest(abs(a.y - b.y), abs(a.x - b.x)) = 1),
{_relaxed(100)}
SELECT page, (node // 32)::INT AS y, (node % 32)::INT AS x, round(v, 6) AS v FROM k100""")
def geodesic_distances(spark, sf):
    m = ml(spark, sf)
    first = m.groupBy("page").agg(F.min(F.struct("y", "x")).alias("p")).select("page", "p.y", "p.x")
    return rounded(tiles.geodesics(m, first, 16), 6)


@query(None)
def endcaps_clipped(spark, sf):
    """Held against a plain version in the tests."""
    return tiles.endcaps_clipped(tiles.thinned(ml(spark, sf), 16, 4), 3.0, 16)


@query(f"""WITH RECURSIVE {PL}, {FRAME}, q AS (SELECT page, y, x, coalesce(v > 0.02, false) AS up, page * 1000000000000 + y * 1000000 + x AS node FROM frame LEFT JOIN pl USING (page, y, x) WHERE y BETWEEN 0 AND 31 AND x BETWEEN 0 AND 31),
e AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM q a JOIN q b ON a.page = b.page AND a.up = b.up AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.up OR abs(a.y - b.y) + abs(a.x - b.x) <= 1)),
{_jumped(24)},
l AS (SELECT q.*, r.c FROM q JOIN j24 r USING (node)), out AS (SELECT DISTINCT c FROM l WHERE NOT up AND (y IN (0, 31) OR x IN (0, 31))),
f AS (SELECT page, c AS outline, NOT any_value(up) AS hole, min(y * 1000 + x) AS p, count(*) AS pixels FROM l WHERE c NOT IN (SELECT c FROM out) GROUP BY page, c),
t AS (SELECT f.page, f.outline, f.hole, n.c AS parent, f.pixels FROM f LEFT JOIN (SELECT * FROM l WHERE c NOT IN (SELECT c FROM out)) n ON n.page = f.page AND n.y = f.p // 1000 - f.hole::INT AND n.x = f.p % 1000 - (NOT f.hole)::INT),
d(outline, depth) AS (SELECT outline, 0 FROM t WHERE parent IS NULL UNION ALL SELECT t.outline, d.depth + 1 FROM d JOIN t ON t.parent = d.outline)
SELECT page, outline, hole, parent, depth, pixels FROM t JOIN d USING (outline)""")
def outline_tree(spark, sf):
    return isolines.outline_tree(pl(spark, sf).where("v > 0.02"), SIZE)


@query(None)
def fitted_sides(spark, sf):
    """Held against a plain version in the tests."""
    return rounded(boundary.fitted_sides(centres(spark, sf), corridor(spark, sf), SIZE, 2.0, 12.0, window=3))


@query(None)
def offset_side_lines(spark, sf):
    """The isoline of the distance to the edge, and its part beside the centreline; held against a plain version in the tests."""
    field = tiles.distances(corridor(spark, sf)).select("page", "y", "x", "v")
    framed = pl(spark, sf).select("page", "y", "x").join(field, ["page", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    loops = isolines.longest_lines(isolines.isolines(framed, 1.5))
    return rounded(isolines.side_arcs(loops, centres(spark, sf), "outer", 3, 20.0, bend=2, span=4), 6)


@query(None)
def rescued_widths(spark, sf):
    """Points snapped to the mask, widths either side, a second look at short ones, none that are too wide; held against a plain version in the tests."""
    held, black = corridor(spark, sf), pl(spark, sf).where("v > 0.2").select("page", "y", "x")
    w = boundary.station_widths(snapped_centres(spark, sf), held, black, SIZE, 14.0, grace=4.0)
    w = boundary.rescued_widths(w, held, black, SIZE, 14.0)
    return rounded(stats.without_high_widths(w).select("path_id", "i", "x", "y", "d_pos", "d_neg", "w", "reason", "rescued"))


def snapped_centres(spark, sf) -> DataFrame:
    c = centres(spark, sf)
    put = spatial.snapped(c.select(F.struct("path_id", "i").alias("point_id"), "page", "x", "y"), corridor(spark, sf), 3)
    near = put.select("point_id.path_id", "point_id.i", F.col("x").alias("sx"), F.col("y").alias("sy"))
    return c.join(near, ["path_id", "i"], "left").select("path_id", "i", "page", F.coalesce("sx", "x").alias("x"), F.coalesce("sy", "y").alias("y"), F.col("x").alias("rx"), F.col("y").alias("ry"))


@query(None)
def centrelines(spark, sf):
    """From the mask to its centreline in one call, ends far apart; held against a plain version in the tests."""
    return rounded(tiles.centrelines(corridor(spark, sf), 3.0, tile=16))


@query(None)
def centrelines_top_bottom(spark, sf):
    """The same between the middles of the first and the last row, with the end caps trimmed."""
    lines = tiles.centrelines(corridor(spark, sf), 0.0, tiles.TOP_BOTTOM, 16)
    return rounded(tiles.caps_trimmed(lines, 1.0))


def pictures(spark, sf) -> DataFrame:
    """Pages in grey, dark where the values are large, with some green and red."""
    grey = (255 - F.floor(F.least(F.lit(255.0), F.abs("v") * 900))).cast("int")
    tint = F.col("x") % 7
    p = pl(spark, sf).withColumn("k", grey)
    return p.select("page", "y", "x", F.when(tint == 3, 20).otherwise(F.col("k")).alias("r"), F.col("k").alias("g"), F.when(tint >= 5, 10).otherwise(F.col("k")).alias("b"))


#: Settings for pages this small; the others are the defaults.
SMALL = footpath.WidthSettings(max_probe=14.0, outside_grace=4.0, snap_radius=3)


@query(None)
def footpath_areas(spark, sf):
    """From picture, mask and centreline to areas; held against a plain version in the tests."""
    return rounded(footpath.path_areas(footpath.path_widths(centres(spark, sf), corridor(spark, sf), pictures(spark, sf), SIZE, SMALL), 0.05), 6)
