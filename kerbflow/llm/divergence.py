"""Divergence of sources by joint count histograms (operator 13).

The documents are counted once into rows (lang, source, term, occurrences, documents).  Each
kept term is then one row with its counts in all sources that have it.  A pair of sources does
not compare its terms one by one: the terms are tallied by their two counts, and the difference
of shares is evaluated once for each distinct (count, count), times how many terms have it.

Only terms that both sources have are tallied from pairs of counts.  The cells with a zero are
implied: ``V`` terms start at (0, 0), each source's own histogram moves its terms to
(count, 0) or (0, count), and a term of both moves on to (count, count).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.llm._cluster import bounded_batches, give_back, sized, written
from kerbflow.llm._text import mapped_bytes, slices, words

#: Documents of a language that must hold a term, for it to be kept.
MIN_DOCS = 30
#: Added to every count; the scale of a share.
PRIOR, SCALE = 5, 1_000_000_000
#: Terms reported for a source.
TOP_TERMS = 50
SLICE = 8 << 20
COUNTS = "lang string, source string, term string, n long, docs long"

#: Letters (A-Z as a-z) and all bytes of other characters stay, the rest parts terms.
TERM_BYTES = np.array([ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(128)] + list(range(128, 256)), np.uint8)


def _counts(batches):
    for batch in batches:
        for part in slices(batch, limit=SLICE):
            codes, off, names = words(mapped_bytes(part.column("text"), TERM_BYTES), lower=False)
            lang, source = part.column("lang").dictionary_encode(), part.column("source").dictionary_encode()
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            key, times = np.unique(codes * part.num_rows + np.repeat(np.arange(part.num_rows), np.diff(off)), return_counts=True)
            groups, group = np.unique(group, return_inverse=True)
            cell = key // part.num_rows * len(groups) + group[key % part.num_rows]
            cell, at, docs = np.unique(cell, return_inverse=True, return_counts=True)
            own = groups[cell % len(groups)]
            columns = [lang.dictionary.take(pa.array(own // len(source.dictionary))), source.dictionary.take(pa.array(own % len(source.dictionary))), names.take(pa.array(cell // len(groups)))]
            n = np.zeros(len(cell), np.int64)
            np.add.at(n, at, times)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])
    give_back()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, n, counts): the terms in at least ``min_docs`` documents of their language, with
    the occurrences in all of them and an array of (source, n) of the sources that have the term."""
    bounded_batches(docs.sparkSession)
    rows = _texts(docs).mapInArrow(_counts, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = rows.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return found.where(F.col("docs") >= min_docs).drop("docs")


def share(count: str, total: str, terms: str) -> F.Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exact."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * cast({count} + {PRIOR} as decimal(19, 0))) div cast({total} + {PRIOR} * {terms} as decimal(19, 0))")


def _histograms(kept: DataFrame, pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, a, b, ca, cb, m): of each pair a < b, how many terms have these two counts."""
    both = kept.select("lang", F.explode("counts").alias("x"), "counts").select("lang", "x", F.explode(F.filter("counts", lambda y: y["source"] > F.col("x.source"))).alias("y"))
    both = both.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.col("x.n").alias("ca"), F.col("y.n").alias("cb")).agg(F.count("*").alias("m"))
    cell = lambda ca, cb, m: F.struct(F.col(ca).alias("ca") if isinstance(ca, str) else F.lit(ca).cast("long").alias("ca"), F.col(cb).alias("cb") if isinstance(cb, str) else F.lit(cb).cast("long").alias("cb"), m.alias("m"))
    m = F.col("m")
    moved = both.select("lang", "a", "b", F.explode(F.array(cell("ca", "cb", m), cell("ca", 0, -m), cell(0, "cb", -m), cell(0, 0, m))).alias("c"))

    own = kept.select("lang", F.explode("counts").alias("x")).groupBy("lang", F.col("x.source").alias("source"), F.col("x.n").alias("n")).agg(F.count("*").alias("m"))
    own = written(own, "histograms")
    as_a = own.withColumnRenamed("source", "a").join(sized(pairs), ["lang", "a"]).select("lang", "a", "b", F.explode(F.array(cell("n", 0, m), cell(0, 0, -m))).alias("c"))
    as_b = own.withColumnRenamed("source", "b").join(sized(pairs), ["lang", "b"]).select("lang", "a", "b", F.explode(F.array(cell(0, "n", m), cell(0, 0, -m))).alias("c"))
    all_zero = pairs.join(sized(terms), "lang").select("lang", "a", "b", cell(0, 0, F.col("v")).alias("c"))
    cells = moved.unionByName(as_a).unionByName(as_b).unionByName(all_zero)
    return cells.groupBy("lang", "a", "b", "c.ca", "c.cb").agg(F.sum("c.m").alias("m")).where("m <> 0")


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from the others.

    Part ``pair``: item is each other source of the language, value the sum over all kept terms of
    the difference of their shares.  Part ``term``: the kept terms that have a larger share in the source than
    in the language, by the difference, at most ``top``.  Ranks go by value, then by item.

    Nulls in text, lang and source count as empty strings.  A group without terms (all texts empty)
    takes part with counts of 0; a language without kept terms has values of 0 and no term
    part; one with a single source has no pairs.  Repeated rows count as often as they occur; an empty table gives
    no rows.  A language's occurrences must stay below 10 ** 18.
    """
    kept = written(kept_terms(docs, min_docs), "kept")
    per_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("total"))
    per_source = kept.select("lang", F.explode("counts").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"))
    groups = _texts(docs).select("lang", "source").distinct().join(per_source, ["lang", "source"], "left").join(per_lang, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = written(groups.select("lang", "source", zero("n"), zero("v"), zero("total")), "groups")

    ends = lambda s: groups.select("lang", F.col("source").alias(s), F.col("n").alias(f"n{s}"), "v")
    pairs = written(ends("a").join(ends("b").drop("v"), "lang").where("a < b"), "pairs")  # as many as the result asks for
    cells = _histograms(kept, pairs.select("lang", "a", "b"), groups.select("lang", "v").distinct())
    apart = cells.join(sized(pairs), ["lang", "a", "b"]).where("v > 0")
    apart = apart.groupBy("lang", "a", "b").agg(F.sum(F.col("m") * F.abs(share("ca", "na", "v") - share("cb", "nb", "v"))).alias("value"))
    apart = pairs.select("lang", "a", "b").join(apart, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    way = lambda s, o: F.struct(F.col(s).alias("source"), F.col(o).alias("item"))
    apart = apart.select("lang", F.explode(F.array(way("a", "b"), way("b", "a"))).alias("w"), "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")

    counts = kept.select("lang", "term", F.col("n").alias("all"), F.explode("counts").alias("x")).select("lang", "x.source", F.lit("term").alias("part"), F.col("term").alias("item"), "all", F.col("x.n").alias("count"))
    counts = counts.join(sized(groups), ["lang", "source"]).withColumn("value", share("count", "n", "v") - share("`all`", "total", "v")).where("value > 0")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.row_number().over(order).alias("rank"))
    return ranked(apart).unionByName(ranked(counts).where(F.col("rank") <= top))
