"""Benchmark decontamination by template canonicalisation (operator 9).

Texts become words (runs of letters and digits; a decimal or grouped number is one).  Numbers
turn into ``<num>``, a unit after a number into ``<unit>``, a capitalised word inside a sentence
into ``<name>``; all else is lower-cased.  Windows of ``WINDOW`` canonical words are
hash-joined with those of the benchmark items.  Matched windows of a document and an item are
laid side by side and their slots compared: within one alignment a value that an item has in
several slots must not stay in one and change in another.  The windows that hold such a value
do not count; windows without slots always do.  (Slots that only happen to be equal in the
item may all change, each to a value of its own.)  What remains decides by the share of the
item's windows that were found, so that questions with other numbers, names or units are
caught like verbatim copies.

Windows that are mostly slots say too little as templates; they are found by their own words,
as is the whole of an item with fewer words than a window.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbflow.llm._cluster import sized, written

WINDOW = 8
#: Least words of a window that are not slots; windows with fewer say too little.
PLAIN = 5
#: Least share of an item's windows.
SHARE = 0.5
#: Units that follow a number.
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml cl l s sec min h hr hrs day days week weeks month months year years hz khz mhz ghz w kw mw v a ma j kj kcal pa kpa bar k c f usd eur gbp percent dollars euros meters metres kilometers kilometres grams kilograms litres liters hours minutes seconds miles feet inches pounds".split()


def _units() -> str:
    return "|".join(sorted(UNITS, key=len, reverse=True))


#: Stands for the mark inside a decimal or grouped number.
MARK = "\u066b"
_NUM, _WORD, _OTHER = rf"\p{{N}}[\p{{N}}{MARK}]*", rf"\p{{L}}\p{{N}}{MARK}", rf"[^\p{{L}}\p{{N}}{MARK}]+"


def _joined(text: Column) -> Column:
    """The text with ``MARK`` for each point, comma, apostrophe or fixed blank between two digits."""
    inside = "[.,'\u2019\u00a0\u202f]"
    return F.regexp_replace(F.translate(text, MARK, " "), rf"{inside}(?<=\p{{N}}{inside})(?=\p{{N}})", MARK)


def canonical_text(text: Column) -> Column:
    """The text with its slots replaced by ``<num>``, ``<unit>`` and ``<name>``, lower-cased.

    A slot is one word, so the words of the result line up with those of ``raw_text``.
    """
    # (?=...) first: it rejects most places at once
    text = F.regexp_replace(_joined(text), r"(?=\p{Lu})(?<=[\p{Ll},] )\p{Lu}\p{Ll}+(?![\p{L}\p{N}])", "<name>")
    text = F.regexp_replace(text, rf"(?=\p{{N}})(?<![{_WORD}]){_NUM} ?(?i:{_units()})(?![\p{{L}}\p{{N}}])", "<num> <unit>")
    return F.lower(F.regexp_replace(text, rf"(?=\p{{N}})(?<![{_WORD}]){_NUM}(?![\p{{L}}\p{{N}}])", "<num>"))


def raw_text(text: Column) -> Column:
    """The text in lower case, with a blank between a number and its unit."""
    return F.lower(F.regexp_replace(_joined(text), rf"(?=\p{{N}})(?<![{_WORD}])({_NUM})((?i:{_units()}))(?![\p{{L}}\p{{N}}])", "$1 $2"))


def canonical_words(text: Column) -> Column:
    return F.filter(F.split(canonical_text(F.translate(text, "<>", "  ")), _OTHER.replace("^", "^<>")), lambda w: w != "")


def raw_words(text: Column) -> Column:
    return F.filter(F.split(raw_text(text), _OTHER), lambda w: w != "")


def _windows(words: Column, width: int = WINDOW) -> Column:
    """Hashes of all windows of an array of words, in order; none if there are fewer words."""
    many = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))
    return F.when(F.size(words) >= width, many).otherwise(F.array().cast("array<bigint>"))


def _is_slot(word: Column) -> Column:
    return F.startswith(word, F.lit("<"))


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, text_hash, item_id, windows, item_windows) for each document that contains an item.

    ``text_hash`` tells rows apart that share a doc_id or have none.  ``item_windows`` counts all
    windows of an item, the whole item if it has fewer than ``WINDOW`` words.  An item is found
    by ``share`` of them, or of those that are not mostly slots, if it has any.  Items without
    words match nothing; neither do null and empty texts.  Repeated rows count once.  Empty
    tables give no rows; further columns are ignored.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    whole = items.select("item_id", canonical_words(F.col("text")).alias("canon"), raw_words(F.col("text")).alias("raw"))
    items = whole.select("item_id", "canon", "raw", F.posexplode(_windows(F.col("canon"))).alias("item_at", "window"))
    items = items.select("item_id", "item_at", "window", F.slice("canon", F.col("item_at") + 1, WINDOW).alias("kinds"), F.slice("raw", F.col("item_at") + 1, WINDOW).alias("item_raw"))
    items = written(items.withColumn("slots", F.size(F.filter("kinds", _is_slot))), "items")
    few = WINDOW - PLAIN
    dense = items.where(F.col("slots") > few).select("item_id", "item_at", F.lit(WINDOW).alias("width"), F.xxhash64("item_raw").alias("window"))
    short = whole.where(F.size("raw").between(1, WINDOW - 1)).select("item_id", F.lit(-1).alias("item_at"), F.size("raw").alias("width"), F.xxhash64("raw").alias("window"))
    exact = written(dense.unionByName(short), "exact")
    items = items.where(F.col("slots") <= few)
    counted = items.select("item_id", "item_at", F.lit(True).alias("plain")).unionByName(exact.select("item_id", "item_at", F.lit(False).alias("plain"))).distinct()
    totals = counted.groupBy("item_id").agg(F.countDistinct("item_at").alias("item_windows"), F.count_if("plain").alias("item_plain"))

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").withColumn("text_hash", F.xxhash64("text"))
    seen = docs.select("doc_id", "text_hash", canonical_words(F.col("text")).alias("canon"))
    seen = seen.select("doc_id", "text_hash", F.posexplode(_windows(F.col("canon"))).alias("doc_at", "window"))
    seen = seen.join(sized(items.select("window").distinct()), "window", "left_semi")
    met = written(seen.join(items, "window").select("doc_id", "text_hash", "doc_at", "item_id", "item_at", "kinds", "item_raw", "slots", (F.col("doc_at") - F.col("item_at")).alias("shift")), "met")

    # only windows with slots need the document's own words
    asked = sized(met.where("slots > 0").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct())
    own = docs.join(asked, docs["doc_id"].eqNullSafe(F.col("d")) & (docs["text_hash"] == F.col("h"))).select("d", "h", raw_words(F.col("text")).alias("raw")).dropDuplicates(["d", "h"])
    slotted = met.where("slots > 0").join(own, met["doc_id"].eqNullSafe(F.col("d")) & (met["text_hash"] == F.col("h")))
    slotted = slotted.withColumn("doc_raw", F.slice("raw", F.col("doc_at") + 1, WINDOW))
    line = ["doc_id", "text_hash", "item_id", "shift"]
    slot = F.explode(F.filter(F.arrays_zip("kinds", "item_raw", "doc_raw"), lambda s: _is_slot(s["kinds"])))
    slots = slotted.select(*line, "item_at", slot.alias("slot")).select(*line, "item_at", "slot.*")
    kept = F.col("item_raw") == F.col("doc_raw")
    broken = slots.groupBy(*line, "kinds", "item_raw").agg(F.max(kept).alias("kept"), F.max(~kept).alias("changed")).where("kept and changed")
    on = [*line, "kinds", "item_raw"]
    broken = broken.select(*[F.col(c).alias("y_" + c) for c in on])
    same = slots["doc_id"].eqNullSafe(F.col("y_doc_id"))
    for c in on[1:]:
        same = same & (slots[c] == F.col("y_" + c))
    line = [*line, "item_at"]
    dropped = slots.join(broken, same).select(*[F.col(c).alias("x_" + c) for c in line]).distinct()
    same = met["doc_id"].eqNullSafe(F.col("x_doc_id"))
    for c in line[1:]:
        same = same & (met[c] == F.col("x_" + c))
    sound = met.join(dropped, same, "left_anti")

    found = sound.select("doc_id", "text_hash", "item_id", "item_at", F.lit(True).alias("plain"))
    widths = sorted(r.width for r in exact.select("width").distinct().collect())  # at most WINDOW
    if widths:
        raw = docs.select("doc_id", "text_hash", raw_words(F.col("text")).alias("raw"))
        own = raw.select("doc_id", "text_hash", F.explode(F.array(*[F.struct(F.lit(w).alias("width"), _windows(F.col("raw"), w).alias("all")) for w in widths])).alias("of"))
        own = own.select("doc_id", "text_hash", "of.width", F.explode("of.all").alias("window"))
        word_for_word = own.join(sized(exact), ["width", "window"]).select("doc_id", "text_hash", "item_id", "item_at", F.lit(False).alias("plain"))
        found = found.unionByName(word_for_word)
    found = found.distinct().groupBy("doc_id", "text_hash", "item_id").agg(F.countDistinct("item_at").alias("windows"), F.count_if("plain").alias("plain"))
    enough = (F.col("windows") >= share * F.col("item_windows")) | ((F.col("item_plain") > 0) & (F.col("plain") >= share * F.col("item_plain")))
    return found.join(totals, "item_id").where(enough).select("doc_id", "text_hash", "item_id", "windows", "item_windows")


def clean_documents(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` without those that contain a benchmark item; columns as they are.

    Null and empty texts stay, and so do repeated rows of clean texts.
    """
    bad = written(leaks(docs, benchmark, share).select(F.col("doc_id").alias("__leaked_id"), F.col("text_hash").alias("__leaked_hash")).distinct(), "leaked")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__leaked_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__leaked_hash"))
    return docs.join(sized(bad), same, "left_anti")
