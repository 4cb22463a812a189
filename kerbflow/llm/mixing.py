"""Mixing sources to target weights (operator 1).

Capped water-filling: the budget (a share of all sizes) is dealt to the sources by weight;
a source that would pass ``max_epochs`` times its own size is clamped there and what it
leaves is dealt again to the others by weight, until none is above.  The fixed point is
found in closed form: sources in ascending order of cap / weight, of which a first part
ends at its cap and the others at ``level * weight``.

A source's epochs ``target / size`` are taken as whole repetitions of every document and,
for the fraction that is left, one more repetition of the documents that come first in a
seeded order.  The document at the cut is taken whole or not at all, whichever is nearer, so a
source's taken words miss its target by at most half of that document.  The cut is found from the sizes summed
by ``2 ** BIN_BITS`` ranges of the order; only the documents of one range per source are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.llm._cluster import set_aside, sized, written

WORD = r"[^\x20\x09-\x0D]+"
#: A source is cut inside one of so many ranges, whose rows one task sorts.
BIN_BITS = 16
#: They are summed in wide ranges of so many of them (a power of 2) first, so that no task sees more than a few hundred sums a source.
WIDE_BITS = 8
HASH_BITS = 52
#: Sources up to which their table is broadcast.
SOURCES = 100_000


def word_count(text) -> F.Column:
    """The number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: float, max_epochs: int) -> DataFrame:
    """Adds ``target`` to a table (source, source_size, weight) with one row per source."""
    ratio = max_epochs * F.col("source_size") / F.col("weight")
    before = Window.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", "source").rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    dealt = (
        sources.withColumn("ratio", ratio)
        .withColumn("total", budget * F.sum("source_size").over(every))
        .withColumn("spent", F.coalesce(F.sum(max_epochs * F.col("source_size")).over(before), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("spent")) / F.sum("weight").over(after))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(every)["level"])
    )
    cap = (max_epochs * F.col("source_size")).cast("double")
    return dealt.withColumn("target", F.coalesce(F.least(cap, F.col("level") * F.col("weight")), cap)).drop("ratio", "total", "spent", "level")


def _cut(bins: DataFrame, wanted: DataFrame) -> DataFrame:
    """(__of, __cut_bin, __before): the first range of each source by which its sizes pass ``__extra``, and the sum ahead of it, from ``__base`` on."""
    upto = Window.partitionBy("__of").orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = bins.withColumn("__upto", F.sum("__bin_size").over(upto)).join(sized(wanted, SOURCES), F.col("__of").eqNullSafe(F.col("__name")))
    sums = sums.withColumn("__upto", F.col("__base") + F.col("__upto")).where("__upto > __extra")
    first = sums.groupBy("__of").agg(F.min(F.struct("__bin", (F.col("__upto") - F.col("__bin_size")).alias("before"))).alias("__cut"))
    return written(first.select("__of", F.col("__cut.__bin").alias("__cut_bin"), F.col("__cut.before").alias("__before")), "cut")


def mix(docs: DataFrame, weights=(3, 1, 2), budget: float = 1.5, max_epochs: int = 2, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source, ...) with size, source_size, target and taken.

    ``weights`` repeats over the sources in code-point order, a null source last.  Null and
    empty texts have size 0 and give 0 words; so does a source of size 0.  Repeated rows
    count as often as they occur; rows that share a doc_id or have none share a place in the
    seeded order and follow one another by size and text.  An empty table gives no rows.  All
    columns stay, but ones of the added names are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    order = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, HASH_BITS // 4), 16, 10).cast("long")
    rows = docs.withColumn("size", word_count(F.col("text"))).withColumn("__at", order)
    rows = rows.withColumn("__bin", F.shiftright("__at", HASH_BITS - BIN_BITS).cast("int"))

    # no name of the plan is left that a column of the documents may have
    bins = written(rows.groupBy(F.col("source").alias("__of"), "__bin").agg(F.sum("size").alias("__bin_size")), "bins")
    sources = bins.groupBy(F.col("__of").alias("source")).agg(F.sum("__bin_size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    plan = water_fill(sources.withColumn("weight", weight), budget, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    extra = F.round(F.col("target")).cast("long") - epochs * F.col("source_size")
    plan = written(plan.select(F.col("source").alias("__name"), "source_size", "target", epochs.alias("__whole"), extra.alias("__extra")), "targets")

    # the range of the cut: first among wide ranges, then among those inside the one found
    wide = bins.groupBy("__of", F.shiftright("__bin", WIDE_BITS).alias("__bin")).agg(F.sum("__bin_size").alias("__bin_size"))
    found = _cut(wide, plan.select("__name", "__extra", F.lit(0).cast("long").alias("__base")))
    same = F.col("__of").eqNullSafe(F.col("__name"))
    inner = plan.select("__name", "__extra").join(found, same).select("__name", "__extra", F.col("__cut_bin").alias("__wide"), F.col("__before").alias("__base"))
    own = bins.join(sized(inner.select(F.col("__name").alias("__n"), "__wide"), SOURCES), F.col("__of").eqNullSafe(F.col("__n")) & (F.shiftright("__bin", WIDE_BITS) == F.col("__wide")))
    cut = _cut(own.select("__of", "__bin", "__bin_size"), inner.select("__name", "__extra", "__base"))
    plan = plan.join(cut, same, "left").select("__name", "source_size", "target", "__whole", "__extra", F.coalesce("__cut_bin", F.lit(1 << BIN_BITS)).alias("__cut_bin"), F.coalesce("__before", F.lit(0)).alias("__before"))
    known = rows.join(sized(written(plan, "plan"), SOURCES), rows["source"].eqNullSafe(F.col("__name")))

    base = F.col("__whole") * F.col("size")
    clear = known.where("__bin <> __cut_bin").withColumn("taken", base + F.when(F.col("__bin") < F.col("__cut_bin"), F.col("size")).otherwise(0))
    # rows of one place, id and size are told apart by their texts
    inside = Window.partitionBy("__name").orderBy("__at", "doc_id", "size", "__text").rowsBetween(Window.unboundedPreceding, -1)
    edge = known.where("__bin = __cut_bin").withColumn("__text", F.xxhash64("text")).withColumn("__ahead", F.col("__before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    edge = edge.withColumn("taken", base + F.when(2 * (F.col("__extra") - F.col("__ahead")) >= F.col("size"), F.col("size")).otherwise(0))
    columns = [*docs.columns, "size", "source_size", "target", F.col("taken").cast("long").alias("taken")]
    return clear.select(*columns).unionByName(edge.select(*columns))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each document as often as it is taken, whole each time.

    Columns as in ``docs``.  Documents that are not taken are not in the mix, so neither are
    null and empty texts; repeated rows are taken each.  All columns stay as they are.
    """
    docs, back = set_aside(docs, ("size", "source_size", "target", "taken"))
    rows = mix(docs, **settings).where("taken > 0")
    whole = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.expr("cast(taken div size as int)"))))
    return whole.select(*docs.columns).withColumnsRenamed(back)
