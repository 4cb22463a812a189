"""Lines of equal value, ordered chains and nested outlines, all as joins.

Nothing here walks along a line: links are ranked by pointer doubling, whose rounds grow with
the logarithm of the longest line, and a line of any length is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.operators import curves
from kerbflow.operators.graph import checkpointed, every_place, labelled

PLACE = ["page", "y", "x"]


def _doubled(steps: DataFrame) -> DataFrame:
    """(node, next, hops, last, low) of steps (a, b) that form chains and loops.

    For a node of a chain, ``last`` is its end and ``hops`` the way there, ``next`` is null; for one of a
    loop, ``next`` is not null and ``low`` the loop's least node.
    """
    ends = steps.select(F.col("b").alias("node")).join(steps.select(F.col("a").alias("node")), "node", "left_anti")
    state = steps.select(F.col("a").alias("node"), F.col("b").alias("next"), F.lit(1).cast("long").alias("hops"), F.col("b").alias("last"), F.col("a").alias("low"))
    zero = ends.select("node", F.lit(None).cast("long").alias("next"), F.lit(0).cast("long").alias("hops"), F.col("node").alias("last"), F.col("node").alias("low"))
    state = checkpointed(state.unionByName(zero))
    open_ = None
    while True:
        ahead = state.select(F.col("node").alias("next"), F.col("next").alias("n2"), F.col("hops").alias("h2"), F.col("last").alias("l2"), F.col("low").alias("w2"))
        moved = state.join(ahead, "next", "left")
        met = F.col("next").isNotNull()
        moved = moved.select(
            "node", F.when(met, F.col("n2")).alias("next"), F.when(met, F.col("hops") + F.col("h2")).otherwise(F.col("hops")).alias("hops"),
            F.when(met, F.col("l2")).otherwise(F.col("last")).alias("last"), F.least("low", "w2").alias("low"), (met & (F.col("w2") < F.col("low"))).alias("lower"),
        )
        moved = checkpointed(moved)
        left, lower = moved.agg(F.count("next"), F.count(F.when(F.col("lower") & F.col("next").isNotNull(), 1))).first()
        state = moved.drop("lower")
        if left == 0 or (left == open_ and lower == 0):
            return state
        open_ = left


def ranked_chains(steps: DataFrame) -> DataFrame:
    """(node, chain, i, closed): the nodes of ``steps`` (a, b) in order along their chain.

    Every node has at most one step out and one in.  A chain is named by its first node, a loop
    is cut before its least one.
    """
    steps = steps.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    found = _doubled(steps)
    loops = found.where("next is not null").select(F.col("node").alias("a"), "low")
    cut = steps.join(loops, "a").where("b <> low").select("a", "b")
    alone = steps.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("last"), F.lit(0).cast("long").alias("hops"), F.lit(True).alias("closed"))
    part = lambda df, closed: df.select("node", "last", "hops", F.lit(closed).alias("closed"))
    ways = part(found.where("next is null"), False).unionByName(alone)
    if not loops.isEmpty():
        ways = ways.unionByName(part(_doubled(cut), True))
    ways = checkpointed(ways)
    heads = ways.groupBy("last").agg(F.max(F.struct("hops", "node")).alias("m")).select("last", F.col("m.node").alias("chain"), F.col("m.hops").alias("most"))
    return ways.join(heads, "last").select("node", "chain", (F.col("most") - F.col("hops")).alias("i"), "closed")


def _edge(y: Column, x: Column, down: int) -> Column:
    """The number of the grid edge that goes right (0) or down (1) from a pixel."""
    return F.col("page") * 2_000_000_000_000 + (y.cast("long") * 1_000_000 + x) * 2 + down


def crossings(field: DataFrame, level: float) -> tuple[DataFrame, DataFrame]:
    """Where a field (page, y, x, v) crosses a level: steps (page, a, b) between grid edges, and the points (node, page, y, x) on these.

    Each cell of four pixels that all have finite values gives a step for each run of corners above the level, from the edge
    by which the run is entered clockwise to the one by which it is left; so corners that meet only
    diagonally stay apart, and the steps of neighbouring cells follow one another.  Pages are below four million.
    """
    f = field.select(F.col("page").cast("long").alias("page"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("v"))
    f = f.where((F.col("v") < float("inf")) & (F.col("v") > float("-inf")))  # NaN is above all
    spread = f.withColumn("o", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for k, (dy, dx) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0)))])))
    spread = spread.select("page", (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"), "o.k", "v")
    cells = spread.groupBy(*PLACE).agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"v{k}") for k in range(4)]).where("v0 + v1 + v2 + v3 is not null")
    high = [F.col(f"v{k}") > level for k in range(4)]
    y, x = F.col("y"), F.col("x")
    edge = [_edge(y, x, 0), _edge(y, x + 1, 1), _edge(y + 1, x, 0), _edge(y, x, 1)]
    steps = []
    for k in range(4):
        leave = F.when(~high[(k + 2) % 4], edge[(k + 1) % 4]).when(~high[(k + 3) % 4], edge[(k + 2) % 4]).otherwise(edge[(k + 3) % 4])
        steps.append(F.when(~high[k] & high[(k + 1) % 4], F.struct(edge[k].alias("a"), leave.alias("b"))))
    links = cells.select("page", F.explode(F.filter(F.array(*steps), lambda s: s.isNotNull())).alias("s")).select("page", "s.a", "s.b")
    cut = lambda a, b: (level - F.col(a)) / (F.col(b) - F.col(a))
    on = lambda k, dy, dx, a, b: F.when(high[a] != high[b], F.struct(edge[k].alias("node"), (y + (cut(f"v{a}", f"v{b}") if dy is None else dy)).cast("double").alias("y"), (x + (cut(f"v{a}", f"v{b}") if dx is None else dx)).cast("double").alias("x")))
    dots = F.array(on(0, 0, None, 0, 1), on(1, None, 1, 1, 2), on(2, 1, None, 3, 2), on(3, None, 0, 0, 3))
    points = cells.select("page", F.explode(F.filter(dots, lambda s: s.isNotNull())).alias("p")).select("p.node", "page", "p.y", "p.x")
    return links, points.dropDuplicates(["node"])


def isolines(field: DataFrame, level: float) -> DataFrame:
    """(page, line, i, y, x, closed): the lines along which a field has the level, values above it on the right of the way.

    Lines end at the border of the field; closed ones begin at the least of their grid edges and end where they begin.
    """
    links, points = crossings(field, level)
    links, points = checkpointed(links), checkpointed(points)
    order = ranked_chains(links).withColumnRenamed("chain", "line")
    rows = checkpointed(points.join(order, "node").select("page", "line", "i", "y", "x", "closed"))
    n = rows.where("closed").groupBy("line").agg(F.count("*").alias("n"))
    again = rows.where("closed and i = 0").join(n, "line").select("page", "line", F.col("n").alias("i"), "y", "x", "closed")
    return rows.unionByName(again)


def longest_lines(lines: DataFrame) -> DataFrame:
    """Of each page the line of most points; of equals the first."""
    lines = checkpointed(lines)
    n = lines.groupBy("page", "line").agg(F.count("*").alias("n"))
    top = n.groupBy("page").agg(F.min(F.struct(-F.col("n"), "line")).alias("t")).select("page", F.col("t.line").alias("line"))
    return lines.join(top, ["page", "line"], "left_semi")


def side_arcs(loops: DataFrame, centre: DataFrame, side: str = "inner", lookahead: int = 20, reach: float = 200.0, lock_height: bool = False, bend: int = 20, span: int = 80) -> DataFrame:
    """(page, i, y, x): the part of a page's loop that runs beside its centreline, from its start to its end.

    ``loops`` are one line a page (page, i, y, x), ``centre`` is (page, i, x, y).  From either end of the
    centreline a target is set ``reach`` away at right angles, towards the centre of its strongest bend for the
    inner side and away from it for the outer one.  The loop is cut at its points nearest to the two targets; of the two
    arcs the inner side takes the one closer to the bend's centre on average, the outer side the other.
    With ``lock_height`` the arc is moved so that the mean height of its ends is that of the centreline's.
    """
    key = "page"
    middle = curves.origins(centre.select(F.col(key), "i", "x", "y"), span, bend, 10, key).select(key, F.col("cx").alias("mx"), F.col("cy").alias("my"))
    w = Window.partitionBy(key)
    c = centre.select(key, "i", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumn("n", F.count("*").over(w))
    k = F.greatest(F.lit(1), F.least(F.lit(int(lookahead)), F.col("n") - 1))
    at = lambda i, v: F.max(F.when(F.col("i") == i, F.col(v)))
    c = c.withColumn("k", k)
    ends = c.groupBy(key).agg(
        *[at(F.lit(0), v).alias(f"s{v}") for v in "xy"], *[at(F.col("k"), v).alias(f"a{v}") for v in "xy"],
        *[at(F.col("n") - 1, v).alias(f"e{v}") for v in "xy"], *[at(F.col("n") - 1 - F.col("k"), v).alias(f"b{v}") for v in "xy"],
    ).join(middle, key)

    def target(p: str, tx: Column, ty: Column) -> tuple[Column, Column]:
        size = F.sqrt(tx * tx + ty * ty)
        nx, ny = (F.when(size >= 1e-9, v / F.when(size >= 1e-9, size)).otherwise(0.0) for v in (ty, -tx))
        inwards = F.when(nx * (F.col("mx") - F.col(f"{p}x")) + ny * (F.col("my") - F.col(f"{p}y")) >= 0, 1.0).otherwise(-1.0)
        sign = inwards * (1.0 if side == "inner" else -1.0) * reach
        return F.col(f"{p}x") + nx * sign, F.col(f"{p}y") + ny * sign

    sx, sy = target("s", F.col("ax") - F.col("sx"), F.col("ay") - F.col("sy"))
    ex, ey = target("e", F.col("ex") - F.col("bx"), F.col("ey") - F.col("by"))
    ends = ends.select("*", sx.alias("gx"), sy.alias("gy"), ex.alias("hx"), ey.alias("hy"))
    # every table that is read more than once is computed once: copies of its plan would double with each step
    loops, ends = checkpointed(loops.select(key, F.col("i").cast("long").alias("i"), "y", "x")), checkpointed(ends)
    p = loops.join(ends, key)
    gap = lambda a, b: (F.col("x") - F.col(a)) ** 2 + (F.col("y") - F.col(b)) ** 2
    marks = p.groupBy(key).agg(F.min(F.struct(gap("gx", "gy").alias("d"), "i"))["i"].alias("i0"), F.min(F.struct(gap("hx", "hy").alias("d"), "i"))["i"].alias("i1"), F.count("*").alias("size"))
    p = p.join(checkpointed(marks), key)
    low, high = F.least("i0", "i1"), F.greatest("i0", "i1")
    # the arc between the marks, and the one over the loop's ends; the marks belong to both
    first_arc = F.col("i0") <= F.col("i1")  # else the arc over the ends is the first of the two
    part = lambda on, inner, at: F.when(on, F.struct(F.when(first_arc == inner, 0).otherwise(1).alias("arc"), at.alias("at")))
    i = F.col("i")
    parts = F.array(part((i >= low) & (i <= high), True, i - low), part(i >= high, False, i - high), part(i <= low, False, i + F.col("size") - high))
    arcs = p.select("*", F.explode(F.filter(parts, lambda s: s.isNotNull())).alias("o"))
    arcs = checkpointed(arcs.select(key, "o.arc", "o.at", "x", "y", "mx", "my", "sx", "sy", "ex", "ey"))
    mean = arcs.groupBy(key, "arc").agg(F.avg(F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2)).alias("r"), F.max("at").alias("last"))
    best = mean.groupBy(key).agg(F.min(F.struct((F.col("r") if side == "inner" else -F.col("r")).alias("r"), "arc", "last")).alias("b")).select(key, F.col("b.arc").alias("arc"), F.col("b.last").alias("last"))
    line = checkpointed(arcs.join(best, [key, "arc"]))
    first = lambda v: F.max(F.when(F.col("at") == 0, F.col(v)))
    end = lambda v: F.max(F.when(F.col("at") == F.col("last"), F.col(v)))
    turn = line.groupBy(key).agg(*[f(v).alias(f"{n}{v}") for n, f in (("p", first), ("q", end)) for v in "xy"])
    line = line.join(turn, key)
    way = lambda a, b: F.sqrt((F.col(f"{a}x") - F.col(f"{b}x")) ** 2 + (F.col(f"{a}y") - F.col(f"{b}y")) ** 2)
    back = way("q", "s") + way("p", "e") < way("p", "s") + way("q", "e")
    moved = F.col("y") + (F.lit(0.0) if not lock_height else 0.5 * (F.col("sy") + F.col("ey")) - 0.5 * (F.col("py") + F.col("qy")))
    return line.select(key, F.when(back, F.col("last") - F.col("at")).otherwise(F.col("at")).alias("i"), moved.alias("y"), "x")


def outline_tree(mask: DataFrame, size: tuple[int, int]) -> DataFrame:
    """(page, outline, hole, parent, depth, pixels): the outer outlines and hole outlines of a mask, and which one lies around which.

    An outer outline belongs to a component by eight neighbours and is named by its number, a hole outline by
    that of its background component by four neighbours; both numbers order a page's pixels by (y, x).  An outer
    outline lies in the hole whose background is left of its first pixel, a hole in the component above its first
    pixel; what lies in no hole has no parent and depth 0.  ``pixels`` counts the component's or the hole's.
    """
    m = checkpointed(mask.select(F.col("page").cast("long").alias("page"), "y", "x").distinct())
    front = checkpointed(labelled(m, 8))
    back = checkpointed(labelled(every_place(m, size).join(m, PLACE, "left_anti"), 4))
    edge = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == size[0] - 1) | (F.col("x") == size[1] - 1)
    outside = back.where(edge).select("page", "component").distinct()
    holes = back.join(outside, ["page", "component"], "left_anti")
    first = lambda df: df.groupBy("page", "component").agg(F.min(F.struct("y", "x")).alias("p"), F.count("*").alias("pixels")).select("page", F.col("component").alias("outline"), "p.y", "p.x", "pixels")
    named = lambda df: df.select(*PLACE, F.col("component").alias("parent"))
    outer = first(front).withColumn("x", F.col("x") - 1).join(named(holes), PLACE, "left").withColumn("hole", F.lit(False))
    inner = first(holes).withColumn("y", F.col("y") - 1).join(named(front), PLACE, "left").withColumn("hole", F.lit(True))
    tree = checkpointed(outer.unionByName(inner).select("page", "outline", "hole", "parent", "pixels"))
    # depths by doubling: each outline jumps to the ancestor that its ancestor has reached
    state = tree.select("page", "outline", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"))
    while not state.where("up is not null").isEmpty():
        ahead = state.select("page", F.col("outline").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        state = checkpointed(state.join(ahead, ["page", "up"], "left").select("page", "outline", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth")))
    return tree.join(state.select("page", "outline", "depth"), ["page", "outline"]).select("page", "outline", "hole", "parent", "depth", "pixels")
