"""Pixel algorithms over pages of any size: by rows and columns, or by square tiles that exchange their borders.

A tile's task holds its own pixels and those of a halo around it, so its memory follows the
tile's size and not the page's.  ``until_stable`` runs the tiles round by round: a round reads what
the rounds before left in the halo, and only tiles whose halo changed take part in the next.
Pages whose box holds at most ``WHOLE`` pixels are not cut: many of them make up a task, which needs no rounds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.operators.graph import PIXELS, _least_reached, checkpointed, dealt, labelled, pixel_graph

PLACE = ["page", "y", "x"]
#: Side of a tile, and rows of a band, in pixels.
TILE = 256
BAND = 64
#: Pixels in the box of a page that is not cut into tiles, and of the pages that are worked on at once.
WHOLE, CANVAS = 1 << 20, 1 << 20
#: A distance where nothing limits it.
FAR = 1 << 30
RING = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
#: Lengths of steps to the neighbours by (y, x), and the order of these in ``RING``.
STEPS, BY_PLACE = np.array([(dy * dy + dx * dx) ** 0.5 for dy, dx in RING]), [RING.index(q) for q in sorted(RING)]


def _slim(pixels: DataFrame, *more: str) -> DataFrame:
    return pixels.select(F.col("page").cast("long").alias("page"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *more)


# -- distances ----------------------------------------------------------------------------


def _column_steps(mask: DataFrame, size: tuple[int, int] | None) -> DataFrame:
    """``up``: steps along its column from each set pixel to the nearest one that is not set, by windows over runs.

    With an image ``size``, places outside do not count, so a run at the edge is open there.
    """
    column = Window.partitionBy("page", "x").orderBy("y")
    p = _slim(mask).distinct().withColumn("run", F.col("y") - F.row_number().over(column))
    run = Window.partitionBy("page", "x", "run")
    above, below = F.col("y") - F.min("y").over(run) + 1, F.max("y").over(run) - F.col("y") + 1
    if size is not None:
        above = F.when(F.min("y").over(run) == 0, FAR).otherwise(above)
        below = F.when(F.max("y").over(run) == size[0] - 1, FAR).otherwise(below)
    return p.select(*PLACE, F.least(above, below).cast("int").alias("up"))


def _row_runs(steps: DataFrame) -> DataFrame:
    row = Window.partitionBy("page", "y").orderBy("x")
    return steps.withColumn("run", F.col("x") - F.row_number().over(row))


def distances(mask: DataFrame, size: tuple[int, int] | None = None, band: int = BAND) -> DataFrame:
    """(page, y, x, v): the exact distance of each set pixel to the nearest one that is not set.

    First along the columns, by windows; then along the rows, ``band`` rows of a page in a
    task, which holds that many times the page's width.  Without ``size`` everything outside
    counts as not set; with it only places inside the image do, and v is infinite where there is none.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf["y"].min()), int(pdf["x"].min())
        y, x = pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0
        column = np.zeros((y.max() + 1, x.max() + 3), np.int64)
        if size is not None:  # places outside the image are none
            column[:, : max(0, 1 - x0)] = FAR * FAR
            column[:, max(0, size[1] - x0 + 1) :] = FAR * FAR
        column[y, x + 1] = pdf["up"].to_numpy().astype(np.int64) ** 2
        best, d = column.copy(), 1
        while d < column.shape[1] and d * d < best.max():
            np.minimum(best[:, d:], column[:, :-d] + d * d, out=best[:, d:])
            np.minimum(best[:, :-d], column[:, d:] + d * d, out=best[:, :-d])
            d += 1
        v = best[y, x + 1]
        return pd.DataFrame({"page": pdf["page"].iloc[0], "y": y + y0, "x": x + x0, "v": np.where(v >= FAR * FAR // 4, np.inf, np.sqrt(v))})

    steps = _column_steps(mask, size).withColumn("band", F.floor(F.col("y") / band))
    return steps.groupBy("page", "band").applyInPandas(run, "page long, y int, x int, v double")


def step_distances(mask: DataFrame, size: tuple[int, int]) -> DataFrame:
    """(page, y, x, v): the least number of steps up, down and sideways from each set pixel to one of the image that is not set; null if the page has none.

    Windows over the runs of columns, then over those of rows.
    """
    p = _row_runs(_column_steps(mask, size))
    run = Window.partitionBy("page", "y", "run")
    ahead, back = run.orderBy("x").rowsBetween(Window.unboundedPreceding, 0), run.orderBy("x").rowsBetween(0, Window.unboundedFollowing)
    left = F.when(F.min("x").over(run) == 0, FAR).otherwise(F.col("x") - F.min("x").over(run) + 1)
    right = F.when(F.max("x").over(run) == size[1] - 1, FAR).otherwise(F.max("x").over(run) - F.col("x") + 1)
    v = F.least(left, right, F.min(F.col("up") - F.col("x")).over(ahead) + F.col("x"), F.min(F.col("up") + F.col("x")).over(back) - F.col("x"))
    return p.withColumn("v", v).select(*PLACE, F.when(F.col("v") < FAR // 2, F.col("v")).alias("v"))


def opening_residues(mask: DataFrame, size: tuple[int, int]) -> DataFrame:
    """The morphological skeleton by a cross: what the openings of all orders take away.

    A pixel with ``v`` steps to the outside is lost by the erosion of order ``v``; the opening
    of that order brings it back unless no neighbour has more steps.  So the skeleton is where
    no neighbour of the four has more steps, and no image has to be eroded again and again.
    A page without a pixel that is not set has no skeleton.
    """
    field = checkpointed(step_distances(mask, size))
    sides = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    near = field.withColumn("o", F.explode(sides)).select("page", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "v")
    top = near.groupBy(*PLACE).agg(F.max("v").alias("top"))
    return field.join(top, PLACE, "left").where("v >= coalesce(top, 0)").select(*PLACE)


# -- tiles --------------------------------------------------------------------------------


def _tiles(tile: int, halo: int):
    """The tiles of which a pixel is part, or part of the halo."""
    span = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))
    return F.explode(F.flatten(F.transform(span("y"), lambda a: F.transform(span("x"), lambda b: F.struct(a.alias("ty"), b.alias("tx"))))))


def _stacked(run: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str], gap: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """``run`` for a share of whole pages: they are put one below the other, ``gap`` apart, and all pixels are own ones.

    Rows that ``run`` returns are known by their index; they get their places back.
    """

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        code, pages = pd.factorize(pdf["page"])
        low, high = (getattr(pdf.groupby(code)[["y", "x"]], f)().to_numpy() for f in ("min", "max"))
        tall, wide = (high - low).T + 1 + gap
        part, top, at, used = np.zeros(len(pages), int), np.zeros(len(pages), int), 0, 0
        for k in np.argsort(wide, kind="stable").tolist():
            if used and (used + tall[k]) * wide[k] > CANVAS:
                at, used = at + 1, 0
            part[k], top[k] = at, used
            used += int(tall[k])
        placed = pdf.assign(y=pdf["y"] - low[code, 0] + top[code], x=pdf["x"] - low[code, 1], own=True)
        out = pd.concat([run(p) for _, p in placed.groupby(part[code])])
        return out.assign(y=pdf["y"].loc[out.index].to_numpy(), x=pdf["x"].loc[out.index].to_numpy())[columns]

    return step


def _whole_and_cut(pixels: DataFrame) -> tuple[Callable[..., DataFrame], DataFrame | None]:
    """``pixels``, computed once: what runs a function on their whole pages, and the pixels of the pages that are cut, if any.

    The first takes the function for ``_stacked``, its result's type and the gap between pages.
    """
    pixels = checkpointed(pixels)
    box = (F.max("y") - F.min("y") + 1).cast("long") * (F.max("x") - F.min("x") + 1)
    boxes = pixels.groupBy("page").agg(box.alias("box"))
    area, large = boxes.agg(F.sum(F.when(F.col("box") <= WHOLE, F.col("box"))), F.count(F.when(F.col("box") > WHOLE, 1))).first()
    rest, cut = pixels, None
    if large:
        pages = checkpointed(boxes.where(F.col("box") > WHOLE).select("page"))
        rest, cut = (pixels.join(pages, "page", how).select(*pixels.columns) for how in ("left_anti", "left_semi"))

    def whole(run: Callable[[pd.DataFrame], pd.DataFrame], kind: str, gap: int) -> DataFrame:
        columns = [c.split()[0] for c in kind.split(", ")]
        return dealt(rest, "page", n=area or 0, rows=PIXELS).applyInPandas(_stacked(run, columns, gap), kind)

    return whole, cut


def until_stable(pixels: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], tile: int, halo: int, settles: bool, most: int = 100_000, ready: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, int]:
    """``pixels`` (page, y, x, ...) after rounds of ``run`` that change nothing any more, and how many rounds it took.

    ``run`` gets the pixels of a tile and its halo, with ``own`` marking the tile's, and returns the
    own ones that stay, with ``changed``.  ``settles``: a tile that sees no news in its halo
    has nothing more to do.  At most ``halo`` <= ``tile``.  Each round is a shuffle of the tiles at work and a checkpoint.

    Pages of at most ``WHOLE`` pixels are done in one round: ``run`` gets several of them in one frame, moved
    apart and all own, whatever their ``page``, and must keep the index and finish what needs no halo.  ``ready`` is
    applied to the pixels of the others first.
    """
    whole, cut = _whole_and_cut(pixels)
    out, rounds = whole(run, ", ".join(f"{c} {t}" for c, t in pixels.dtypes), halo + 1), 1
    if cut is None:
        return out, rounds
    cut, rounds = _by_tiles(cut if ready is None else ready(cut), run, tile, halo, settles, most)
    return cut.unionByName(out), rounds


def _by_tiles(pixels: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], tile: int, halo: int, settles: bool, most: int) -> tuple[DataFrame, int]:
    """``until_stable`` for pages that are cut."""
    columns = pixels.columns
    kind = ", ".join(f"{c} {t}" for c, t in pixels.dtypes) + ", changed boolean, ty long, tx long"
    at = lambda df: df.withColumn("ty", F.floor(F.col("y") / tile)).withColumn("tx", F.floor(F.col("x") / tile))
    where = ["page", "ty", "tx"]

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = pdf["ty"].iloc[0], pdf["tx"].iloc[0]
        pdf["own"] = (pdf["y"] // tile == ty) & (pdf["x"] // tile == tx)
        out = run(pdf)
        return out[[*columns, "changed"]].assign(ty=ty, tx=tx)

    state = checkpointed(at(pixels).withColumn("changed", F.lit(True)).select(*columns, "changed", "ty", "tx"))
    news = state.select(*where).distinct()
    for rounds in range(1, most + 1):
        news = checkpointed(news)
        if news.isEmpty():
            return state.select(*columns), rounds - 1
        spread = state.select(*columns, _tiles(tile, halo).alias("t")).select(*columns, "t.ty", "t.tx")
        held = spread.join(news, where, "left_semi").groupBy(*where).applyInPandas(step, kind)
        rest = state.join(news, where, "left_anti").withColumn("changed", F.lit(False))
        state = checkpointed(held.unionByName(rest))
        told = state.where("changed").select("page", F.col("ty").alias("from_y"), F.col("tx").alias("from_x"), _tiles(tile, halo).alias("t"))
        if settles:
            told = told.where("t.ty <> from_y or t.tx <> from_x")
        # a tile can be told by pixels that are gone, so it is known by its place alone
        news = told.select("page", "t.ty", "t.tx").distinct().join(state.select(*where).distinct(), where, "left_semi")
    raise RuntimeError(f"not stable after {most} rounds")


def _grid(pdf: pd.DataFrame, pad: int = 1) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """Rows and columns of the pixels in a padded array of their box, and its shape."""
    y, x = pdf["y"].to_numpy() - int(pdf["y"].min()) + pad, pdf["x"].to_numpy() - int(pdf["x"].min()) + pad
    return y, x, (int(y.max()) + 1 + pad, int(x.max()) + 1 + pad)


def _shifted(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """Each place's neighbour at (dy, dx); what wraps around lands on the padding."""
    return np.roll(a, (-dy, -dx), (0, 1))


def _near(pdf: pd.DataFrame) -> np.ndarray:
    """The row of each pixel's neighbours in the order of ``RING``, the number of rows where there is none."""
    y, x, shape = _grid(pdf)
    row = np.full(shape, len(pdf), np.int32)
    row[y, x] = np.arange(len(pdf), dtype=np.int32)
    return np.stack([row[y + dy, x + dx] for dy, dx in RING], 1)


def _reached(near: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``v``, the length of the way to each pixel, once no step to a neighbour shortens any; infinite where there is none."""
    v, front = np.append(v, -np.inf), np.flatnonzero(v < np.inf)
    while len(front):
        to, way = near[front], v[front, None] + STEPS
        less = way < v[to]
        to = to[less]
        np.minimum.at(v, to, way[less])
        front = np.unique(to)
    return v[:-1]


def _firsts(page: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """The first row of each page by ``order``."""
    at = np.lexsort((*order[::-1], page))
    return at[np.append(True, page[at][1:] != page[at][:-1])] if len(at) else at


def _far_rows(pdf: pd.DataFrame, near: np.ndarray) -> list[np.ndarray]:
    """Of pages in one frame, the rows of the first and the second far end, as ``far_ends`` has them."""
    page, y, x = (pdf[c].to_numpy() for c in PLACE)
    ends = np.flatnonzero((near < len(pdf)).sum(1) == 1)
    ends = ends[pd.Series(page[ends]).duplicated(keep=False).to_numpy()]
    at, out = ends[_firsts(page[ends], y[ends], x[ends])], []
    for _ in range(2):
        v = _from_rows(near, at)[ends]
        met = ends[v < np.inf]
        # ways of one length are summed in different orders
        at = met[_firsts(page[met], -v[v < np.inf].round(6), y[met], x[met])]
        out.append(at)
    return out


def _from_rows(near: np.ndarray, starts: np.ndarray) -> np.ndarray:
    v = np.full(len(near), np.inf)
    v[starts] = 0.0
    return _reached(near, v)


def _thinned_once(g: np.ndarray) -> np.ndarray:
    for side in (0, 1):
        p = [_shifted(g, dy, dx) for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
        n = sum(x.astype(np.uint8) for x in p)
        turns = sum((~p[k] & p[(k + 1) % 8]).astype(np.uint8) for k in range(8))
        if side == 0:
            free = ~(p[0] & p[2] & p[4]) & ~(p[2] & p[4] & p[6])
        else:
            free = ~(p[0] & p[2] & p[6]) & ~(p[0] & p[4] & p[6])
        g = g & ~((n >= 2) & (n <= 6) & (turns == 1) & free)
    return g


def thinned(mask: DataFrame, tile: int = TILE, passes: int = 8) -> DataFrame:
    """The skeleton by two-pass thinning, as ``raster.skeleton`` has it for a page in one task.

    A tile makes ``passes`` double passes a round; what it cannot know moves inwards by a pixel
    a pass, so a halo of twice as many keeps its own pixels exact.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x, shape = _grid(pdf)
        g = np.zeros(shape, bool)
        g[y, x] = True
        own = pdf["own"].to_numpy()
        done = 0
        while done < passes or own.all():  # without a halo nothing is unknown
            new, done = _thinned_once(g), done + 1
            if (new == g).all():
                break
            g = new
        left, gone = own & g[y, x], own & ~g[y, x]
        # a pixel that goes tells the tiles around it by its last row
        return pdf[own].assign(alive=g[y, x][own], changed=gone[own]) if gone.any() else pdf[left].assign(changed=False)

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        alive = pdf[pdf["alive"]]
        return run(alive) if len(alive) else alive.assign(changed=False)

    found, _ = until_stable(_slim(mask).distinct().withColumn("alive", F.lit(True)), step, tile, 2 * passes, False)
    return found.where("alive").select(*PLACE)


def _one_piece() -> np.ndarray:
    """For each pattern of the eight neighbours, whether at least two are set and all hang together."""
    out = np.zeros(256, bool)
    for pattern in range(256):
        left = {RING[k] for k in range(8) if pattern >> k & 1}
        if len(left) >= 2:
            reach = [left.pop()]
            while reach:
                y, x = reach.pop()
                near = {q for q in left if abs(q[0] - y) <= 1 and abs(q[1] - x) <= 1}
                left -= near
                reach += near
            out[pattern] = not left
    return out


def medial_axis(mask: DataFrame, tile: int = TILE, size: tuple[int, int] | None = None) -> DataFrame:
    """(page, y, x, v): the medial axis of a mask, with the distance to the outside on it.

    Pixels are taken away in order of their distance, then of how many neighbours they have
    (more first), then by (y, x); one stays if it is an end or if its neighbours would fall apart.  A
    pixel is decided once all neighbours before it are, which gives the result of the one order
    whatever the tiles.
    """
    able = _one_piece()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x, shape = _grid(pdf)
        # without a halo all neighbours are here
        corner = 8 - (_near(pdf) < len(pdf)).sum(1) if pdf["own"].all() else pdf["corner"]
        order = np.lexsort((pdf["x"], pdf["y"], corner, pdf["v"]))
        rank, state, own = np.zeros(shape, np.int64), np.full(shape, 2, np.int8), np.zeros(shape, bool)
        rank[y[order], x[order]] = np.arange(len(order))
        state[y, x], own[y, x] = pdf["state"], pdf["own"]
        # pixels are decided wave by wave; each knows how many undecided neighbours come before it
        state, rank, own = state.ravel(), rank.ravel(), own.ravel()
        steps = [dy * shape[1] + dx for dy, dx in RING]
        waiting = np.flatnonzero(own & (state == 0))
        wait, changed = np.zeros(len(state), np.int8), np.zeros(len(state), bool)
        for step in steps:
            near = waiting + step
            wait[waiting] += (state[near] == 0) & (rank[near] < rank[waiting])
        ready = waiting[wait[waiting] == 0]
        while len(ready):
            pattern = np.zeros(len(ready), np.int64)
            for k, step in enumerate(steps):
                pattern |= (state[ready + step] != 2).astype(np.int64) << k  # neighbours that come later are still there
            state[ready] = np.where(able[pattern], 2, 1)
            changed[ready] = True
            freed = []
            for step in steps:
                near = ready + step
                near = near[own[near] & (state[near] == 0)]
                wait[near] -= 1
                freed.append(near[wait[near] == 0])
            ready = np.concatenate(freed)
        state, changed = state.reshape(shape), changed.reshape(shape)
        mine = pdf["own"].to_numpy()
        return pdf[mine].assign(state=state[y, x][mine], changed=changed[y, x][mine])

    def cornered(field: DataFrame) -> DataFrame:
        field = checkpointed(field)
        offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in RING])
        near = field.withColumn("o", F.explode(offsets)).select("page", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
        near = near.groupBy(*PLACE).agg(F.count("*").cast("int").alias("n"))
        return field.join(near, PLACE, "left").select(*PLACE, "v", (8 - F.coalesce("n", F.lit(0))).alias("corner"), "state")

    rows = distances(mask, size).select(*PLACE, "v", F.lit(0).alias("corner"), F.lit(0).cast("tinyint").alias("state"))
    found, _ = until_stable(rows, run, tile, 1, True, ready=cornered)
    return found.where("state = 1").select(*PLACE, "v")


def disc_seeds(pixels: DataFrame, least: int, tile: int = TILE) -> DataFrame:
    """(page, seed, y, x): pixels taken row by row, each clearing the disc of radius ``least``, as ``graph.greedy_seeds`` has it.

    A pixel is cleared by any seed before it in its disc, and becomes a seed once all pixels before it in
    its disc are cleared.  Needs ``least`` <= ``tile``.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        y, x, own = pdf["y"].to_numpy(), pdf["x"].to_numpy(), pdf["own"].to_numpy()
        before = pdf["state"].to_numpy()
        state = before.copy()

        def later(k):
            end = np.searchsorted(y, y[k] + least, side="right")
            return k + 1 + np.flatnonzero((y[k + 1 : end] - y[k]) ** 2 + (x[k + 1 : end] - x[k]) ** 2 <= least * least)

        for k in np.flatnonzero(before == 1):
            reach = later(k)
            state[reach[state[reach] == 0]] = 2
        stuck = np.zeros(len(y), bool)  # something undecided comes before in the disc
        for k in range(len(y)):
            if state[k] == 0:
                reach = later(k)
                if own[k] and not stuck[k]:
                    state[k] = 1
                    state[reach[state[reach] == 0]] = 2
                else:
                    stuck[reach] = True
        return pdf[own].assign(state=state[own], changed=(state != before)[own])

    found, _ = until_stable(_slim(pixels).distinct().withColumn("state", F.lit(0).cast("tinyint")), run, tile, least, True)
    order = F.row_number().over(Window.partitionBy("page").orderBy("y", "x")) - 1
    return found.where("state = 1").select("page", order.cast("long").alias("seed"), "y", "x")


# -- ways along a skeleton --------------------------------------------------------------------


def geodesics(pixels: DataFrame, starts: DataFrame, tile: int = TILE) -> DataFrame:
    """(page, y, x, v): the length of the shortest way over set pixels (eight neighbours) to a page's nearest start; pixels out of reach have none.

    A tile lengthens the ways over its own pixels from what its halo knows; rounds follow the tiles
    that a shortest way crosses, not its pixels.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near, own, known = _near(pdf), pdf["own"].to_numpy(), pdf["v"].fillna(np.inf).to_numpy()
        near[~np.append(own, False)[near]] = len(pdf)  # a tile changes its own pixels
        v = _reached(near, known)
        return pdf.assign(v=np.where(v < np.inf, v, np.nan), changed=v < known)[own]

    first = _slim(starts).distinct().withColumn("v", F.lit(0.0))
    found, _ = until_stable(_slim(pixels).distinct().join(first, PLACE, "left").select(*PLACE, "v"), run, tile, 1, True)
    return found.where("v is not null and not isnan(v)")


def far_ends(skeleton: DataFrame, tile: int = TILE) -> DataFrame:
    """(page, role, y, x): of each page's end pixels (one neighbour) the two that are far apart, by two sweeps from the first one by (y, x).

    Of ends equally far the first counts; ends out of reach and pages with fewer than two ends give none.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _far_rows(pdf, _near(pdf))
        return pd.concat([pdf.iloc[r].assign(role=role) for r, role in zip(rows, "ab")])

    whole, cut = _whole_and_cut(_slim(skeleton).distinct())
    found = whole(run, "page long, role string, y int, x int", 2)
    return found if cut is None else found.unionByName(_far_ends_cut(cut, tile))


def _far_ends_cut(pixels: DataFrame, tile: int) -> DataFrame:
    """``far_ends`` by tiles."""
    p = checkpointed(pixels)
    e = pixel_graph(p)
    ends = e.select("page", F.col("ay").alias("y"), F.col("ax").alias("x")).union(e.select("page", F.col("by"), F.col("bx"))).groupBy(*PLACE).agg(F.count("*").alias("n")).where("n = 1").select(*PLACE)
    ends = ends.withColumn("n", F.count("*").over(Window.partitionBy("page"))).where("n > 1").select(*PLACE)
    ends = checkpointed(ends)
    at = ends.groupBy("page").agg(F.min(F.struct("y", "x")).alias("p")).select("page", "p.y", "p.x")
    out = None
    for role in ("a", "b"):
        far = geodesics(p, at, tile).join(ends, PLACE, "left_semi")
        # ways of one length are summed in different orders
        at = checkpointed(far.groupBy("page").agg(F.min(F.struct(-F.round("v", 6), "y", "x")).alias("p")).select("page", "p.y", "p.x"))
        named = at.withColumn("role", F.lit(role))
        out = named if out is None else out.unionByName(named)
    return out.select("page", "role", "y", "x")


def endcaps_clipped(skeleton: DataFrame, clip: float, tile: int = TILE) -> DataFrame:
    """The skeleton without all pixels, side branches too, whose way to either far end is shorter than ``clip``; then its largest component.

    Pages with fewer than three pixels or two ends, and those of which nothing would be left, stay.
    """
    p = _slim(skeleton).distinct()
    if clip <= 0:
        return p

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near, page = _near(pdf), pdf["page"].to_numpy()
        kept = np.ones(len(pdf), bool)
        for r in _far_rows(pdf, near):
            v = _from_rows(near, r)
            kept &= (v < np.inf) & (v.round(6) >= clip)
        few = ~np.isin(page, page[kept]) | (pdf.groupby("page")["y"].transform("size").to_numpy() < 3)
        left = np.flatnonzero(kept & ~few)
        row = np.full(len(pdf) + 1, -1)
        order = left[np.lexsort((pdf["x"].to_numpy()[left], pdf["y"].to_numpy()[left]))]
        row[order] = np.arange(len(order))
        to = row[near[order]]
        part = _least_reached(len(order), np.nonzero(to >= 0)[0], to[to >= 0])
        size = np.bincount(part, minlength=len(order))[part]
        top = part[_firsts(page[order], -size, part)]
        return pdf.iloc[np.append(order[np.isin(part, top)], np.flatnonzero(few))]

    whole, cut = _whole_and_cut(p)
    found = whole(run, "page long, y int, x int", 2)
    return found if cut is None else found.unionByName(_endcaps_clipped_cut(cut, clip, tile))


def _endcaps_clipped_cut(pixels: DataFrame, clip: float, tile: int) -> DataFrame:
    """``endcaps_clipped`` by tiles."""
    p = checkpointed(pixels)
    ends = checkpointed(_far_ends_cut(p, tile))
    way = {role: geodesics(p, ends.where(F.col("role") == role), tile) for role in ("a", "b")}
    near = way["a"].join(way["b"].withColumnRenamed("v", "w"), PLACE)
    kept = checkpointed(near.where((F.round("v", 6) >= clip) & (F.round("w", 6) >= clip)).select(*PLACE))
    enough = p.groupBy("page").agg(F.count("*").alias("n")).where("n >= 3").join(kept.select("page").distinct(), "page", "left_semi").select("page")
    parts = labelled(kept.join(enough, "page", "left_semi"))
    size = parts.groupBy("page", "component").agg(F.count("*").alias("n"))
    top = size.groupBy("page").agg(F.min(F.struct(-F.col("n"), "component")).alias("t")).select("page", F.col("t.component").alias("component"))
    clipped = parts.join(top, ["page", "component"], "left_semi").select(*PLACE)
    return clipped.unionByName(p.join(enough, "page", "left_anti").select(*PLACE))


def nearest_pixels(pixels: DataFrame, points: DataFrame) -> DataFrame:
    """(page, y, x): the pixel of its page nearest to each page's point (page, py, px); of equals the first by (y, x)."""
    d = (F.col("y") - F.col("py")) ** 2 + (F.col("x") - F.col("px")) ** 2
    near = _slim(pixels).join(points.select("page", "py", "px"), "page")
    return near.groupBy("page").agg(F.min(F.struct(d.alias("d"), "y", "x")).alias("p")).select("page", "p.y", "p.x")


def ways(pixels: DataFrame, starts: DataFrame, goals: DataFrame, tile: int = TILE) -> DataFrame:
    """(page, i, y, x, v): a shortest way over set pixels from each page's start to its goal, with the length so far.

    Every pixel points to the neighbour it is reached from (the first by (y, x) of equal ones), and the goal leads back. In
    pages that are cut the pixels on the way are gathered by doubling the pointers, so rounds follow the logarithm of the way.
    Pages whose goal is out of reach have none.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near, start, goal = _near(pdf), pdf["start"].to_numpy(), pdf["goal"].to_numpy()
        v = np.append(_from_rows(near, np.flatnonzero(start)).round(6), np.inf)
        back, found = np.full(len(pdf), -1), np.zeros(len(pdf), bool)
        for k in reversed(BY_PLACE):
            leads = np.flatnonzero((v[:-1] < np.inf) & (np.abs(np.where(v < np.inf, v, -9.0)[near[:, k]] + STEPS[k] - v[:-1]) < 1e-5))
            back[leads] = near[leads, k]
        at = np.flatnonzero(goal & (v[:-1] < np.inf))
        while len(at):
            found[at] = True
            at = np.unique(back[at])
            at = at[(at >= 0) & ~found[at]]
        at = np.flatnonzero(found)
        return pdf.iloc[at].assign(v=v[at])

    mark = lambda df, a, b: _slim(df).select(*PLACE, F.lit(a).alias("s"), F.lit(b).alias("g"))
    marks = mark(starts, True, False).union(mark(goals, False, True)).groupBy(*PLACE).agg(F.max("s").alias("start"), F.max("g").alias("goal"))
    no = F.lit(False)
    marked = _slim(pixels).distinct().join(marks, PLACE, "left").select(*PLACE, F.coalesce("start", no).alias("start"), F.coalesce("goal", no).alias("goal"))
    whole, cut = _whole_and_cut(marked)
    found = whole(run, "page long, y int, x int, v double", 2)
    if cut is not None:
        cut = checkpointed(cut)
        found = found.unionByName(_ways_cut(cut, cut.where("start"), cut.where("goal"), tile))
    order = F.row_number().over(Window.partitionBy("page").orderBy("v", "y", "x")) - 1
    return found.select("page", order.cast("long").alias("i"), "y", "x", "v")


def _ways_cut(pixels: DataFrame, starts: DataFrame, goals: DataFrame, tile: int) -> DataFrame:
    """The pixels of ``ways``, by tiles."""
    field = checkpointed(geodesics(pixels, starts, tile).withColumn("v", F.round("v", 6)))
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(round((dy * dy + dx * dx) ** 0.5, 9)).alias("c")) for dy, dx in RING])
    told = field.withColumn("o", F.explode(offsets)).select("page", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.col("y").alias("fy"), F.col("x").alias("fx"), (F.col("v") + F.col("o.c")).alias("w"))
    from_ = told.join(field, PLACE).where(F.abs(F.col("w") - F.col("v")) < 1e-5).groupBy(*PLACE).agg(F.min(F.struct("fy", "fx")).alias("f"))
    jump = checkpointed(from_.select(*PLACE, F.col("f.fy").alias("fy"), F.col("f.fx").alias("fx")))
    found = checkpointed(_slim(goals).distinct().join(field, PLACE, "left_semi").select(*PLACE))
    while True:
        more = found.join(jump, PLACE).select("page", F.col("fy").alias("y"), F.col("fx").alias("x")).join(found, PLACE, "left_anti")
        more = checkpointed(more.distinct())
        if more.isEmpty():
            break
        found = checkpointed(found.unionByName(more))
        twice = jump.select("page", F.col("y").alias("fy"), F.col("x").alias("fx"), F.col("fy").alias("gy"), F.col("fx").alias("gx"))
        jump = checkpointed(jump.join(twice, ["page", "fy", "fx"]).select(*PLACE, F.col("gy").alias("fy"), F.col("gx").alias("fx")))
    return field.join(found, PLACE, "left_semi").select(*PLACE, "v")


#: How the ends of a centreline are chosen.
FARTHEST, TOP_BOTTOM = "farthest-endpoints", "top-bottom"


def centreline_ends(mask: DataFrame, skeleton: DataFrame, strategy: str = FARTHEST, tile: int = TILE) -> DataFrame:
    """(page, role, y, x): the two ends, a and b, of a page's centreline on its skeleton.

    Either the end pixels far apart, or the skeleton's pixels nearest to the middle of the mask's first and last row.
    """
    if strategy == FARTHEST:
        return far_ends(skeleton, tile)
    if strategy != TOP_BOTTOM:
        raise ValueError(f"unknown strategy {strategy}")
    spans = _slim(mask).groupBy("page", F.col("y").cast("double").alias("py")).agg((0.5 * (F.min("x") + F.max("x"))).alias("px"))
    middles = checkpointed(spans.groupBy("page").agg(F.min(F.struct("py", "px")).alias("a"), F.max(F.struct("py", "px")).alias("b")))
    found = [nearest_pixels(skeleton, middles.select("page", f"{role}.*")).withColumn("role", F.lit(role)) for role in "ab"]
    out = found[0].unionByName(found[1])
    return out.select("page", "role", "y", "x")


def centrelines(mask: DataFrame, clip: float = 0.0, strategy: str = FARTHEST, tile: int = TILE, size: tuple[int, int] | None = None) -> DataFrame:
    """(page, i, y, x, v, distance): the centreline of each page's shape: the medial axis, its end caps clipped, and the shortest way between two ends.

    ``v`` is the length so far, ``distance`` that to the shape's edge, by which ends can be trimmed.  Pages whose
    ends cannot be chosen or do not hang together have none.
    """
    axis = checkpointed(medial_axis(mask, tile, size))
    skeleton = checkpointed(endcaps_clipped(axis, clip, tile))
    ends = checkpointed(centreline_ends(mask, skeleton, strategy, tile))
    way = ways(skeleton, ends.where("role = 'a'"), ends.where("role = 'b'"), tile)
    return way.join(axis.select(*PLACE, F.col("v").alias("distance")), PLACE, "left").select("page", "i", "y", "x", "v", "distance")


def caps_trimmed(lines: DataFrame, factor: float, least: float = 0.0) -> DataFrame:
    """Centrelines without the points closer along the way to either end than ``factor`` times the end's distance to the edge, at least ``least``."""
    w = Window.partitionBy("page")
    at = lambda c, f: F.max(F.when(F.col("i") == f, F.col(c))).over(w)
    p = lines.withColumn("last", F.max("i").over(w)).withColumn("total", F.max("v").over(w))
    head, tail = (F.greatest(F.lit(float(least)), factor * F.coalesce(at("distance", f), F.lit(0.0))) for f in (F.lit(0), F.col("last")))
    p = p.withColumn("head", head).withColumn("tail", tail).where("v >= head and total - v >= tail")
    return p.select("page", (F.row_number().over(w.orderBy("i")) - 1).cast("long").alias("i"), "y", "x", F.col("v") - F.min("v").over(w), "distance").toDF("page", "i", "y", "x", "v", "distance")
