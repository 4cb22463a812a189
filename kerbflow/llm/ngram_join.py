"""N-gram Jaccard join with a count-vector R-tree (operator 7).

Every text becomes the set of its distinct word shingles; texts with equal sets collapse
to one class.  Two classes link when ``100 * |A n B| >= percent * |A u B|``.

1. *Cells.*  A linked pair shares one of the ``n - ceil(t n) + 1`` first shingles of either
   set, in any fixed order of all shingles.  The order puts shingles that are frequent in
   the corpus last (a counting sketch of fixed size over all texts), the rest by hash, so
   that passages which many texts share open few cells.
2. *Centres.*  In each cell every class is verified against the cell's first class.  That
   is linear in the rows and joins the mass of a large group of near copies at once.
3. *R-tree.*  In the cells that still hold several components, shingles are hashed into
   ``GROUPS`` groups; the group counts are points in an R-tree, packed by set size and then
   by the most spread coordinate.  A node's coordinatewise maxima bound the overlap of a
   query with all points below by the summed coordinate minima; what is left under the
   points themselves is verified exactly; in the larger cells a first search takes the
   best partners of each query only, so that few pairs are left for the second, which takes all.  Cells over ``BLOCK`` rows are split into pairs
   of blocks, one task each.

No pair that links is lost: cells are complete, and the R-tree only drops pairs whose bound
is below the needed overlap or whose ends are already in one component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbflow.llm import _text
from kerbflow.llm._cluster import SLICES, bounded_batches, components, give_back, merged_sketch, partitions, sketch_rows, written

WIDTH, PERCENT = 5, 80
#: Groups of small sets, and of the largest.
GROUPS, MOST_GROUPS = 128, 8192
CELL_BITS = 22
CELLS = 1 << CELL_BITS
BLOCK = 4096
LEAF = 32
#: Partners of each query in the first of the two searches.
BEST = 3
FILTER_BITS = 24


def groups_of(size: int) -> int:
    """Groups for a set of that many shingles: about as many as shingles, a power of 4 times ``GROUPS``."""
    groups = GROUPS
    while groups < MOST_GROUPS and 4 * groups <= size:
        groups *= 4
    return groups


def count_vector(values: np.ndarray, groups: int | None = None) -> np.ndarray:
    """How many of a set's shingles fall in each group."""
    groups = groups or groups_of(len(values))
    return np.bincount((values >> np.uint64(40)).astype(np.int64) % groups, minlength=groups)


def folded(vectors: np.ndarray, groups: int) -> np.ndarray:
    """Count vectors, one a row, with their groups joined into fewer."""
    return vectors.reshape(len(vectors), -1, groups).sum(axis=1)


class CountTree:
    """A packed R-tree over count vectors.

    ``search`` returns the points whose summed coordinate minima with the query reach the
    overlap that two sets of these sizes need.
    """

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, percent: int = PERCENT, leaf: int = LEAF):
        self.vectors, self.sizes, self.percent, self.leaf = vectors, sizes, percent, leaf
        self.order = np.arange(len(sizes))
        if len(sizes) <= leaf:
            return  # one leaf, its own root
        order = np.argsort(sizes, kind="stable")
        slab = leaf * leaf
        packed = []
        for a in range(0, len(order), slab):
            part = order[a : a + slab]
            axis = int(np.argmax(vectors[part].var(axis=0))) if len(part) > leaf else 0
            packed.append(part[np.argsort(vectors[part, axis], kind="stable")])
        self.order = np.concatenate(packed)
        cuts = np.arange(0, len(order), leaf)
        self.leaves = [self.order[a : a + leaf] for a in cuts]
        self.leaf_top = np.array([vectors[x].max(axis=0) for x in self.leaves]).reshape(len(cuts), -1)
        self.leaf_size = np.array([(sizes[x].min(), sizes[x].max()) for x in self.leaves]).reshape(-1, 2)
        groups = np.arange(0, len(cuts), leaf)
        self.node_top = np.array([self.leaf_top[a : a + leaf].max(axis=0) for a in groups]).reshape(len(groups), -1)
        self.node_size = np.array([(self.leaf_size[a : a + leaf, 0].min(), self.leaf_size[a : a + leaf, 1].max()) for a in groups]).reshape(-1, 2)

    def _pass(self, vector, size, tops, low, high):
        """Whether the bound reaches the least overlap for partners of ``low`` to ``high``."""
        p = self.percent
        near = (100 * high >= p * size) & (100 * size >= p * low)
        need = p * (size + np.maximum(low, -(-p * size // 100)))
        return near & ((100 + p) * np.minimum(tops, vector).sum(axis=1) >= need)

    def search(self, vector: np.ndarray, size: int) -> np.ndarray:
        if len(self.order) <= self.leaf:
            return self.order[self._pass(vector, size, self.vectors, self.sizes, self.sizes)]
        nodes = np.flatnonzero(self._pass(vector, size, self.node_top, *self.node_size.T))
        if not len(nodes):
            return np.zeros(0, np.int64)
        leaves = (nodes[:, None] * self.leaf + np.arange(self.leaf)).ravel()
        leaves = leaves[leaves < len(self.leaves)]
        leaves = leaves[self._pass(vector, size, self.leaf_top[leaves], *self.leaf_size[leaves].T)]
        if not len(leaves):
            return np.zeros(0, np.int64)
        points = np.concatenate([self.leaves[k] for k in leaves])
        s = self.sizes[points]
        return points[self._pass(vector, size, self.vectors[points], s, s)]


def _first_pass(width: int):
    def run(batches):
        give_back()
        sketch = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for part in _text.slices(batch):
                sets = _text.shingle_sets(part.column("text"), width)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                sketch += np.bincount((flat >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=CELLS).astype(np.uint32)
                none = pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())
                vectors = [_packed(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [_text.long_column(part, "doc_id"), pa.array([_text.set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(vectors, pa.binary()), *none],
                    ["doc_id", "sid", "n", "vector", "slice", "part"],
                )
        ids, parts = sketch_rows(sketch)
        empty = pa.nulls(len(ids), pa.int64())
        yield pa.RecordBatch.from_arrays([empty, empty, empty, pa.nulls(len(ids), pa.binary()), pa.array(ids, pa.int32()), pa.array(parts, pa.binary())], ["doc_id", "sid", "n", "vector", "slice", "part"])

    return run


def _order_levels(sketch: np.ndarray) -> np.ndarray:
    """For each sketch cell 0 if its count is ordinary, else the count's bit length."""
    mean = sketch.mean()
    usual = mean + 8 * np.sqrt(mean) + 16  # beyond what chance puts in one cell
    often = np.flatnonzero(sketch > usual)
    level = np.zeros(len(sketch), np.uint8)
    level[often] = np.ceil(np.log2(sketch[often].astype(float) + 2))
    return level


def _prefixes(width: int, percent: int, levels):
    def run(batches):
        give_back()
        level, seen = levels.value, set()
        for batch in batches:
            for part in _text.slices(batch):
                keys, sids, sizes = [], [], []
                for s in _text.shingle_sets(part.column("text"), width):
                    sid, n = _text.set_id(s), len(s)
                    if not n or sid in seen:
                        continue
                    seen.add(sid)
                    take = n - -(-percent * n // 100) + 1
                    key = (level[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(57)) | (s >> np.uint64(7))
                    keys.append(np.partition(key, take - 1)[:take])
                    sids.append(np.full(take, sid, np.int64))
                    sizes.append(np.full(take, n, np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sids)), pa.array(np.concatenate(sizes).astype(np.int32))], ["cell", "sid", "n"])

    return run


def _shared_cells(batches):
    """Of rows sorted by (cell, sid): the distinct ones of cells with several, with the cell's first sid."""
    last: tuple | None = None  # the row that the next batch may continue
    first: tuple | None = None  # the cell's first sid and its size, once rows of the cell were returned
    for batch in batches:
        cell, sid, n = (batch.column(k).to_numpy() for k in range(3))
        if not len(cell):
            continue
        head = last is not None
        if head:
            cell, sid, n = np.r_[last[0], cell], np.r_[last[1], sid], np.r_[last[2], n]
        new = np.r_[True, (cell[1:] != cell[:-1]) | (sid[1:] != sid[:-1])]
        cell, sid, n = cell[new], sid[new], n[new]
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        length = np.diff(np.r_[starts, len(cell)])
        pivot, pivot_n = np.repeat(sid[starts], length), np.repeat(n[starts], length)
        many = np.repeat(length > 1, length)
        if head and first is not None:
            pivot[: length[0]], pivot_n[: length[0]] = first
            many[: length[0]] = True
            many[0] = False  # already returned
        # the last row may gain company in the next batch
        alone = length[-1] == 1 and not (head and first is not None and len(starts) == 1)
        first = None if alone else (pivot[-1], pivot_n[-1])
        last = (cell[-1], sid[-1], n[-1])
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (cell, sid, n.astype(np.int32), pivot, pivot_n.astype(np.int32))], ["cell", "sid", "n", "pivot", "pivot_n"])


def _filter_cell(ids: np.ndarray) -> np.ndarray:
    return (_text.mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _marks(batches):
    marks = np.zeros(1 << FILTER_BITS, bool)
    for batch in batches:
        ids = batch.column(0).drop_null().to_numpy()
        marks[_filter_cell(ids)] = True
    packed = np.packbits(marks).reshape(SLICES, -1)
    full = [k for k in range(SLICES) if packed[k].any()]
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([pa.compress(packed[k].tobytes(), "zstd", asbytes=True) for k in full], pa.binary())], ["slice", "part"])


def _membership(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size for the ids of a column, a bit a cell; false positives only cost work."""
    width = (1 << FILTER_BITS) // 8 // SLICES

    def either(batches):
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                piece = np.frombuffer(pa.decompress(part, width, "zstd", asbytes=True), np.uint8)
                have[k] = have[k] | piece if k in have else piece
        if have:
            yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([x.tobytes() for x in have.values()], pa.binary())], ["slice", "part"])

    kind = "slice int, part binary"
    out = np.zeros((SLICES, width), np.uint8)
    for row in ids.mapInArrow(_marks, kind).repartition(SLICES, "slice").mapInArrow(either, kind).collect():
        out[row.slice] = np.frombuffer(row.part, np.uint8)
    return out.reshape(-1)


def _marked(marks: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether the filter has the cells of ``ids``."""
    cell = _filter_cell(ids)
    return (marks[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)


def _sets_of(width: int, wanted):
    def run(batches):
        give_back()
        marks, seen = wanted.value, set()
        for batch in batches:
            ids = _text.long_column(batch, "doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            keep = null | _marked(marks, ids.fill_null(0).to_numpy())
            for part in _text.slices(batch.filter(pa.array(keep))):
                sids, sets = [], []
                for s in _text.shingle_sets(part.column("text"), width):
                    sid = _text.set_id(s)
                    if len(s) and sid not in seen:
                        seen.add(sid)
                        sids.append(sid)
                        sets.append(s)
                if sets:
                    yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), _text.long_lists(sets)], ["sid", "items"])

    return run


def _packed(values: np.ndarray) -> bytes:
    """A count vector in bytes: the width of a count, then the counts."""
    vector = count_vector(values)
    width = 1 if vector.max() < 256 else 4
    return bytes([width]) + vector.astype(f"<u{width}").tobytes()


def _vector(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)[None]


def _bounded(percent: int):
    """Keeps pairs whose summed coordinate minima reach the overlap that their sizes need."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b, m, n in zip(*(batch.column(c).to_pylist() for c in ("left", "right", "a_n", "b_n"))):
                a, b = _vector(a), _vector(b)
                groups = min(a.shape[1], b.shape[1])
                keep.append((100 + percent) * int(np.minimum(folded(a, groups), folded(b, groups)).sum()) >= percent * (m + n))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that link, by their exact sets."""
    spark = docs.sparkSession
    ends = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    ends = written(ends.join(classes.select("sid", "first_id"), "sid"), "ends")
    wanted = spark.sparkContext.broadcast(_membership(ends.select("first_id")))
    sets = docs.select("doc_id", "text").mapInArrow(_sets_of(width, wanted), "sid long, items array<long>")
    sets = written(sets.join(ends.select("sid"), "sid", "left_semi"), "sets")
    left = pairs.join(sets.select(F.col("sid").alias("b"), F.col("items").alias("right")), "b")
    both = left.join(sets.select(F.col("sid").alias("a"), F.col("items").alias("left")), "a")
    common = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - common
    return written(both.where(100 * common >= percent * union).select("a", "b").distinct(), "verified")


def _tree_pairs(percent: int, best: int | None):
    """Of rows sorted by (cell, i, j): pairs of different components that the R-tree keeps.

    With ``best`` only so many a query, those of the highest bounds.
    """

    def group(side, sid, n, comp, vector, diagonal):
        """``vector`` maps a number of groups to (the rows that have it, their vectors)."""
        found = []
        ask, held = (np.arange(len(sid)),) * 2 if diagonal else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        if not len(ask) or not len(held):
            return found
        # each pair of components is searched from the smaller one
        _, of, size = np.unique(comp, return_inverse=True, return_counts=True)
        place = np.argsort(np.argsort(size, kind="stable"), kind="stable")[of] if diagonal else np.where(side == 1, len(size), 0)
        ask = ask[place[ask] < place[held].max()]
        trees: dict = {}
        for groups, (rows, own) in vector.items():
            for wide, (points, tops) in vector.items():
                points_in = np.isin(points, held)
                asked = np.isin(rows, ask)
                if not points_in.any() or not asked.any():
                    continue
                least = min(groups, wide)
                key = wide, least
                if key not in trees:
                    trees[key] = points[points_in], CountTree(folded(tops[points_in], least), n[points[points_in]], percent)
                base, tree = trees[key]
                for k, v in zip(rows[asked], folded(own[asked], least)):
                    at = tree.search(v, n[k])
                    hits = base[at]
                    fit = (comp[hits] != comp[k]) & (place[hits] > place[k])
                    hits, at = hits[fit], at[fit]
                    if best is not None and len(hits) > best:
                        bound = np.minimum(tree.vectors[at], v).sum(axis=1) / (n[hits] + n[k])
                        hits = hits[np.argsort(-bound, kind="stable")[:best]]
                    if len(hits):
                        found.append(np.stack([np.full(len(hits), sid[k]), sid[hits]]))
        return found

    def run(batches):
        rest = None
        for batch in batches:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            cell, i, j = (rest.column(c).to_numpy() for c in ("cell", "i", "j"))
            starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]) if len(cell) else np.zeros(0, int)
            if len(starts) > 1:
                yield from emit(rest.slice(0, starts[-1]), starts[:-1])
                rest = rest.slice(starts[-1]).combine_chunks()
        if rest is not None and len(rest):
            cell, i, j = (rest.column(c).to_numpy() for c in ("cell", "i", "j"))
            starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            yield from emit(rest, starts)

    def emit(table, starts):
        side, sid, n, comp, i, j = (table.column(c).to_numpy() for c in ("side", "sid", "n", "comp", "i", "j"))
        n, raw = n.astype(np.int64), table.column("vector").to_pylist()
        width = np.array([(len(v) - 1) // v[0] for v in raw])
        found = []
        for a, b in zip(starts, [*starts[1:], len(sid)]):
            vector = {}
            for groups in np.unique(width[a:b]):
                rows = np.flatnonzero(width[a:b] == groups)
                vector[int(groups)] = rows, np.concatenate([_vector(raw[a + r]) for r in rows])
            found += group(side[a:b], sid[a:b], n[a:b], comp[a:b], vector, i[a] == j[a])
        if found:
            out = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(out.min(axis=0)), pa.array(out.max(axis=0))], ["a", "b"])

    return run


def _near(cells: DataFrame, vectors: DataFrame, found: DataFrame, percent: int, best: int | None) -> DataFrame:
    """Pairs (a < b) of classes that share a cell, are in different components and pass the R-tree.

    A cell of two is left out, as its one pair has been tried; of cells with the same classes
    one is searched.  With ``best`` only the cells of more than a leaf are, and only the best
    partners of each class taken.
    """
    named = cells.select("cell", "sid", "n").join(found.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("component", "sid"))
    mixed = named.groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows"), F.bit_xor(F.xxhash64("sid")).alias("same"))
    mixed = mixed.where(f"lo < hi and rows > {2 if best is None else LEAF}").groupBy("same", "rows").agg(F.min("cell").alias("cell"))
    mixed = mixed.select("cell", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    rows = named.join(mixed, "cell").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    rows = rows.join(vectors, "sid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side")
    rows = rows.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side, "sid", "n", "comp", "vector")
    rows = rows.repartition(partitions(cells.sparkSession), "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return rows.mapInArrow(_tree_pairs(percent, best), "a long, b long").distinct()


def ngram_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    Null and empty texts have no shingles and stay alone (component_id is their own doc_id).
    A text with fewer than ``width`` words is one shingle.  Equal texts, also in repeated
    rows, share a component; component_id is the least non-null doc_id in it.  Further
    columns are ignored.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, sid long, n long, vector binary, slice int, part binary"
    base = written(docs.mapInArrow(_first_pass(width), kind), "sets")
    members = base.where("slice is null").select("doc_id", "sid", "n", "vector")
    levels = spark.sparkContext.broadcast(_order_levels(merged_sketch(base.where("slice is not null"), CELLS)))
    give_back()
    classes = written(members.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("first_id")), "classes")

    cells = docs.mapInArrow(_prefixes(width, percent, levels), "cell long, sid long, n int")
    cells = cells.repartition(partitions(spark), "cell").sortWithinPartitions("cell", "sid")
    cells = written(cells.mapInArrow(_shared_cells, "cell long, sid long, n int, pivot long, pivot_n int"), "cells")
    vectors = written(members.where("n > 0").groupBy("sid").agg(F.first("vector").alias("vector")), "vectors")

    centred = cells.where(f"pivot <> sid and 100 * n >= {percent} * pivot_n and 100 * pivot_n >= {percent} * n")
    centred = centred.select(F.col("pivot").alias("a"), F.col("sid").alias("b"), F.col("pivot_n").alias("a_n"), F.col("n").alias("b_n")).distinct()
    both = centred.join(vectors.select(F.col("sid").alias("b"), F.col("vector").alias("right")), "b").join(vectors.select(F.col("sid").alias("a"), F.col("vector").alias("left")), "a")
    centred = written(both.mapInArrow(_bounded(percent), "a long, b long"), "centred")
    links = _verified(docs, classes, centred, width, percent)
    # the likeliest links first, so that a large group is one component before the full search
    found = written(components(links), "components")
    for best in (BEST, None):
        near = written(_near(cells, vectors, found, percent, best).join(centred, ["a", "b"], "left_anti"), "near")
        if near.isEmpty():
            continue
        links = _verified(docs, classes, near, width, percent)
        if not links.isEmpty():  # the components so far stand for the links so far
            found = written(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)), "components")
    both = found.withColumnRenamed("node", "sid")

    # tables of their own, so that no join shares an aggregate's shuffle and the rows of a large group can be split
    least = written(classes.join(both, "sid").groupBy("component").agg(F.min("first_id").alias("component_id")), "least")
    named = classes.join(both.join(least, "component"), "sid", "left").select("sid", F.coalesce("component_id", "first_id").alias("component_id"))
    named = written(named, "named")
    out = members.select("doc_id", "sid", "n").join(named, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
