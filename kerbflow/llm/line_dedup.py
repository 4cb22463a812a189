"""Line dedup by pairwise alignment (operator 8).

A repeated block of ``BLOCK_WORDS`` words or more holds, for each of its lines, a *run* around
it: the fewest adjacent lines with as many words, counted forward from a line or back from
one.  Every run that several documents share, whatever the length of its lines, retrieves
one pair for each later document: that document and the first one with the run.  So a run
costs as many pairs as it has copies, however frequent it is, and each line of a repeated
block is in a run whose first holder is paired.  (Lines retrieved singly would pair a
document with holders that have its lines apart.)  Lines without a word take no part in runs and
alignment; those between two deleted lines go with them.

A pair is aligned by patience diff on line hashes: lines that occur once in either document
are matched in the longest common order, matches grow over equal neighbours, and what lies
between is aligned likewise.  Aligned runs of lines with ``BLOCK_WORDS`` words or more are
deleted from the later document, and so are those that both have but that the alignment
left, such as blocks in another order or with no line that occurs once.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbflow.llm._cluster import bounded_batches, written

BLOCK_WORDS = 12


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first, that also rises in the second."""
    tops, where, before = [], [], []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        before.append(where[p - 1] if p else -1)
        if p == len(tops):
            tops.append(j)
            where.append(k)
        else:
            tops[p], where[p] = j, k
    out, k = [], where[-1] if where else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def patience(left, right) -> list[tuple[int, int]]:
    """Aligned positions (in left, in right) of two sequences, rising in both."""
    matched, todo = [], [(0, len(left), 0, len(right))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and left[a] == right[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and left[b - 1] == right[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a >= b or c >= d:
            continue
        ones: list[dict] = []
        for seq, lo, hi in ((left, a, b), (right, c, d)):
            seen: dict = {}
            for k in range(lo, hi):
                seen[seq[k]] = -1 if seq[k] in seen else k
            ones.append(seen)
        common = [(k, ones[1][h]) for h, k in ones[0].items() if k >= 0 and ones[1].get(h, -1) >= 0]
        anchors = _increasing(sorted(common))
        if not anchors:
            continue
        i, j = a, c
        for x, y in [*anchors, (b, d)]:
            if x > i and y > j:
                todo.append((i, x, j, y))
            if x < b:
                matched.append((x, y))
            i, j = x + 1, y + 1
    return sorted(matched)


def runs(words, least: int = BLOCK_WORDS) -> set[tuple[int, int]]:
    """(first, end) of the fewest adjacent lines with ``least`` words from each line on and back from each line."""
    upto = np.concatenate([[0], np.cumsum(np.asarray(words, np.int64))])
    n = len(upto) - 1
    end = np.searchsorted(upto, upto[:-1] + least)
    first = np.searchsorted(upto, upto[1:] - least, side="right") - 1
    forward = {(s, e) for s, e in enumerate(end.tolist()) if e <= n}
    return forward | {(s, e + 1) for e, s in enumerate(first.tolist()) if s >= 0}


def run_hashes(lines, words, least: int = BLOCK_WORDS) -> list[tuple[int, int, int]]:
    """(first, end, signed hash) of the runs of a document's line hashes."""
    flat = np.asarray(lines, "<i8")
    return [(s, e, xxhash.xxh3_64_intdigest(flat[s:e].tobytes()) - (1 << 63)) for s, e in sorted(runs(words, least))]


def repeated_lines(left, right, words, least: int = BLOCK_WORDS) -> list[int]:
    """Positions in ``right`` of the blocks of at least ``least`` words that ``left`` has, aligned or not."""
    out, block = set(), []
    for pair in [*patience(left, right), (-9, -9)]:
        if block and (pair[0] != block[-1][0] + 1 or pair[1] != block[-1][1] + 1):
            if sum(words[j] for _, j in block) >= least:
                out.update(j for _, j in block)
            block = []
        block.append(pair)
    left_over = [(s, e) for s, e in runs(words, least) if any(j not in out for j in range(s, e))]
    if left_over:
        count = dict(zip(right, words))  # a run of ``left`` that ``right`` lacks needs no words
        parts, part = [], []
        for h in [*left, None]:
            if h in count:
                part.append(h)
            elif part:
                parts.append(part)
                part = []
        known = {tuple(p[s:e]) for p in parts for s, e in runs([count[h] for h in p], least)}
        for s, e in left_over:
            if tuple(right[s:e]) in known:
                out.update(range(s, e))
    return sorted(out)


def _aligned(batches):
    for batch in batches:
        cut = []
        for left, right, words, at in zip(*(batch.column(c) for c in ("first_lines", "lines", "words", "at"))):
            at = at.values.to_pylist()
            found = repeated_lines(left.values.to_pylist(), right.values.to_pylist(), words.values.to_pylist())
            # from the lines with words to all, with those without between two that go
            cut.append([p for k, j in enumerate(found) for p in (range(at[j], at[j + 1]) if found[k + 1 : k + 2] == [j + 1] else [at[j]])])
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("hash"), pa.array(cut, pa.list_(pa.int32()))], ["doc", "hash", "cut"])


def _run_uses(batches):
    for batch in batches:
        found, counts = [], []
        for lines, words in zip(batch.column("lines"), batch.column("words")):
            mine = {h for _, _, h in run_hashes(lines.values.to_numpy(), words.values.to_numpy())}
            found += mine
            counts.append(len(mine))
        place = pa.array(np.repeat(np.arange(len(counts)), counts))
        yield pa.RecordBatch.from_arrays([batch.column("doc").take(place), batch.column("hash").take(place), pa.array(found, pa.int64())], ["doc", "hash", "run"])


def _lines(text) -> F.Column:
    return F.split(text, "\n")


def repeated_positions(docs: DataFrame) -> DataFrame:
    """(doc, hash, cut): the line positions to delete, for the texts that lose any.

    A document is known by its doc_id and the hash of its text, and comes before another if it
    is less in this order.
    """
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc", F.xxhash64("text").alias("hash"), _lines(F.col("text")).alias("line"))
    trimmed = F.transform("line", lambda x: F.trim(x))
    told = F.transform(trimmed, lambda x, i: F.struct(F.xxhash64(x).alias("line"), F.regexp_count(x, F.lit(r"\S+")).alias("words"), i.alias("at")))
    rows = rows.select("doc", "hash", F.filter(told, lambda t: t["words"] > 0).alias("told")).select("doc", "hash", F.col("told.line").alias("lines"), F.col("told.words").alias("words"), F.col("told.at").alias("at"))
    rows = written(rows.distinct(), "lines")
    bounded_batches(docs.sparkSession)
    uses = written(rows.mapInArrow(_run_uses, "doc long, hash long, run long"), "uses")
    first = uses.groupBy("run").agg(F.min(F.struct("doc", "hash")).alias("first"), F.count("*").alias("uses")).where("uses > 1")
    # a table of its own, so that the join does not share the aggregate's shuffle and a frequent run's rows can be split
    pairs = uses.join(written(first.select("run", "first"), "first").hint("merge"), "run").select("doc", "hash", F.col("first.doc").alias("first_doc"), F.col("first.hash").alias("first_hash"))
    pairs = pairs.where("doc <> first_doc or hash <> first_hash").distinct()
    pairs = pairs.join(rows.select(F.col("doc").alias("first_doc"), F.col("hash").alias("first_hash"), F.col("lines").alias("first_lines")), ["first_doc", "first_hash"])
    pairs = pairs.join(rows, ["doc", "hash"]).select("doc", "hash", "first_lines", "lines", "words", "at")
    cuts = pairs.mapInArrow(_aligned, "doc long, hash long, cut array<int>")
    cuts = cuts.select("doc", "hash", F.explode("cut").alias("at")).distinct()
    return cuts.groupBy("doc", "hash").agg(F.sort_array(F.collect_set("at")).alias("cut"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the repeated blocks deleted from ``text``; adds ``n_lines`` and ``removed``.

    ``removed`` lists the deleted positions.  Rows whose doc_id or text is null stay as they
    are, with no lines removed; rows repeated under one doc_id are one document.  All other
    columns stay; an empty table gives no rows.
    """
    docs = docs.drop("n_lines", "removed")
    cuts = written(repeated_positions(docs), "cuts").select(F.col("doc").alias("__doc"), F.col("hash").alias("__hash"), F.col("cut").alias("removed"))
    same = (F.col("doc_id").cast("long") == F.col("__doc")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__hash"))
    # by shuffle at every size: how many cuts there are follows the corpus
    out = docs.join(cuts.hint("merge"), same, "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    lines = _lines(F.col("text"))
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("removed"), i)), "\n")
    out = out.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)))
    return out.withColumn("text", F.when(F.size("removed") > 0, kept).otherwise(F.col("text"))).select(*docs.columns, "n_lines", "removed")
