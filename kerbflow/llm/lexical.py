"""Ranked lexical search by MaxScore (operator 12).

An inverted index is a table with one row a shard; a shard holds the documents of about
``SHARD_BYTES`` of text with, for each of their terms, the postings (document, occurrences) and
two figures from which an upper bound of the term's share of any score follows: the most
occurrences in a document and the least length of a document that has it.

A task searches its shards one after the other and carries each item's k-th best score along.
In a shard an item's terms are ordered by upper bound.  The longest first part of them whose
bounds together stay below the k-th score is *non-essential*: a document with those terms alone
cannot qualify.  The postings of the essential terms are added up; the non-essential ones are
probed, the highest bound first, only for documents whose sum so far and the bounds still
ahead reach the k-th score.  Equal scores go on, since ties fall to the smaller doc_id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.llm._cluster import bounded_batches, give_back, written
from kerbflow.llm._text import long_column, mapped_bytes, slices, words

SHARD_BYTES = 16 << 20
#: (item, term) pairs that are searched for in one pass over the index and go to all tasks.
PACK_TERMS = 200_000
INDEX = "n_docs long, n_tokens long, doc_ids array<bigint>, lengths binary, terms array<string>, df binary, docs binary, tfs binary, max_tf binary, min_length binary"

#: Digits and letters (A-Z as a-z) and all bytes of other characters stay, the rest parts terms.
TERM_BYTES = np.array([ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)] + list(range(128, 256)), np.uint8)


def postings(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of the texts: terms, documents and occurrences by term and document; the terms' names; each text's length."""
    codes, off, names = words(mapped_bytes(texts, TERM_BYTES), lower=False)
    length = np.diff(off)
    n = max(len(length), 1)
    key, times = np.unique(codes * n + np.repeat(np.arange(len(length)), length), return_counts=True)
    return key // n, key % n, times, names, length


def _shard(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
    table = pa.Table.from_batches(parts).combine_chunks()
    term, doc, times, names, length = postings(table.column("text").combine_chunks())
    held = length > 0
    if not held.any():
        return None
    doc = (np.cumsum(held) - 1)[doc]  # texts without terms are in no shard
    length = length[held]
    start = np.flatnonzero(np.diff(term, prepend=-1))
    small = lambda x: x.astype("<i4").tobytes()
    row = {
        "n_docs": pa.array([len(length)], pa.int64()),
        "n_tokens": pa.array([length.sum()], pa.int64()),
        "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(length)], pa.int32()), table.column("doc_id").combine_chunks().cast(pa.int64()).filter(pa.array(held))),
        "lengths": small(length),
        "terms": pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
        "df": small(np.diff(start, append=len(term))),
        "docs": small(doc),
        "tfs": small(times),
        "max_tf": small(np.maximum.reduceat(times, start)),
        "min_length": small(np.minimum.reduceat(length[doc], start)),
    }
    return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) if isinstance(v, bytes) else v for v in row.values()], list(row))


def _shards(batches):
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, limit=SHARD_BYTES):
            more = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if held and size + more > SHARD_BYTES:
                made = _shard(held)
                if made is not None:
                    yield made
                held, size = [], 0
            held.append(part)
            size += more
    if held:
        made = _shard(held)
        if made is not None:
            yield made
    give_back()


def build_index(docs: DataFrame) -> DataFrame:
    """The index of ``docs`` (doc_id, text), written in the shared folder; every text with a term is in it."""
    bounded_batches(docs.sparkSession)
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_shards, INDEX), "shards")


def item_terms(items: DataFrame) -> DataFrame:
    """The distinct (item_id, term) of ``items`` (item_id, text); rows of one item_id are one item."""

    def run(batches):
        for batch in batches:
            term, item, _, names, _ = postings(batch.column("text"))
            yield pa.RecordBatch.from_arrays([long_column(batch, "item_id").take(pa.array(item)), names.take(pa.array(term))], ["item_id", "term"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, term string").distinct()


def _frequencies(names: pa.Array):
    """Sums the documents of the named terms over a task's shards."""

    def run(batches):
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                at = pc.index_in(names, value_set=batch.column("terms")[k].values)
                have = at.is_valid().to_numpy(zero_copy_only=False)
                total[have] += np.frombuffer(batch.column("df")[k].as_py(), "<i4")[at.drop_null().to_numpy()]
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["term", "df"])

    return run


class Shard:
    """A row of the index, opened for the named terms; ``weight`` is theirs, ``n`` and ``total`` are of all documents."""

    def __init__(self, row: dict, names: pa.Array, weight: np.ndarray, n: int, total: int):
        self.ids, lengths = row["doc_ids"], np.frombuffer(row["lengths"], "<i4").astype(np.int64)
        self.drag = 8 * self._m(lengths, n, total)
        at = pc.index_in(names, value_set=row["terms"])
        self.at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False)
        self.end = np.cumsum(np.frombuffer(row["df"], "<i4"), dtype=np.int64)
        self.docs, self.tfs = np.frombuffer(row["docs"], "<i4"), np.frombuffer(row["tfs"], "<i4")
        self.weight = weight
        most, least = (np.frombuffer(row[c], "<i4").astype(np.int64)[self.at] for c in ("max_tf", "min_length"))
        self.bound = np.where(self.at >= 0, weight * self._ratio(most, 8 * self._m(least, n, total)), 0)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _m(length, n, total):
        return 100 - 90 + (90 * length * n) // total

    @staticmethod
    def _ratio(tf, drag):
        return (1_000_000_000 * tf) // (1000 * tf + drag)

    def _range(self, term: int) -> slice:
        k = self.at[term]
        return slice(self.end[k - 1] if k else 0, self.end[k])

    def listed(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents of a term and its share of their scores."""
        if term not in self.open:
            own = self._range(term)
            docs = self.docs[own]
            self.open[term] = docs, self.weight[term] * self._ratio(self.tfs[own].astype(np.int64), self.drag[docs])
        return self.open[term]

    def probed(self, term: int, docs: np.ndarray) -> np.ndarray:
        """The term's share of the scores of ascending ``docs``."""
        own = self._range(term)
        have, tfs = self.docs[own], self.tfs[own]
        at = np.minimum(np.searchsorted(have, docs), len(have) - 1)
        hit = have[at] == docs
        out = np.zeros(len(docs), np.int64)
        out[hit] = self.weight[term] * self._ratio(tfs[at[hit]].astype(np.int64), self.drag[docs[hit]])
        return out

    def top(self, terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the k best, and their scores; none below ``floor``."""
        terms = terms[self.bound[terms] > 0]
        terms = terms[np.argsort(self.bound[terms], kind="stable")]
        ahead = np.cumsum(self.bound[terms])
        least = int(np.searchsorted(ahead, floor))  # so many terms are non-essential
        if least == len(terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        score = np.zeros(len(self.drag), np.int64)
        for t in terms[least:]:
            docs, share = self.listed(t)
            score[docs] += share
        docs = np.flatnonzero(score)
        score = score[docs]
        for j in range(least - 1, -1, -1):
            if len(score) >= k:  # sums so far only grow
                floor = max(floor, int(np.partition(score, len(score) - k)[len(score) - k]))
            able = score + ahead[j] >= floor
            docs, score = docs[able], score[able]
            if not len(docs):
                break
            score = score + self.probed(terms[j], docs)
        if len(score) > k:
            floor = max(floor, int(np.partition(score, len(score) - k)[len(score) - k]))
        able = score >= floor
        return docs[able], score[able]


#: Rows without doc_id come last among equal scores.
LAST = np.iinfo(np.int64).max


def _search(items: list, names: pa.Array, starts: np.ndarray, terms: np.ndarray, weight: np.ndarray, n: int, total: int, k: int):
    def run(batches):
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in items]
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].values if c in ("doc_ids", "terms") else batch.column(c)[r].as_py() for c in batch.schema.names}
                shard = Shard(row, names, weight, n, total)
                for i in range(len(items)):
                    ids, score, known = best[i]
                    floor = int(score[-1]) if len(score) == k else 1
                    docs, more = shard.top(terms[starts[i] : starts[i + 1]], k, floor)
                    if len(docs):
                        own = shard.ids.take(pa.array(docs))
                        ids = np.concatenate([ids, pc.fill_null(own, LAST).to_numpy(zero_copy_only=False)])
                        known = np.concatenate([known, own.is_valid().to_numpy(zero_copy_only=False)])
                        score = np.concatenate([score, more])
                        first = np.lexsort((~known, ids, -score))[:k]
                        best[i] = ids[first], score[first], known[first]
        size = [len(b[0]) for b in best]
        flat = [np.concatenate(x) for x in zip(*best)] if best else [np.zeros(0, np.int64)] * 3
        item = pa.array(items, pa.int64()).take(pa.array(np.repeat(np.arange(len(items)), size)))
        yield pa.RecordBatch.from_arrays([item, pa.array(flat[0], mask=~flat[2].astype(bool)), pa.array(flat[1])], ["item_id", "doc_id", "score"])
        give_back()

    return run


def ranked_search(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of ``index`` that score best for each of ``items``.

    Scores are whole numbers as the query's contract has them; only scores above 0 count, equal
    ones rank by doc_id, rows without doc_id last.  Repeated rows and rows that share a doc_id are
    documents each; rows of ``items`` that share an item_id (or have none) are one item.  Null texts
    and texts without terms match nothing, empty tables give no rows.  90 x a document's
    terms x the documents must stay below 2 ** 63.
    """
    spark = index.sparkSession
    bounded_batches(spark)
    kinds = "item_id long, doc_id long, score long"
    n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    asked = written(item_terms(items), "terms")
    packs = max(1, -(-asked.count() // PACK_TERMS))
    found = spark.createDataFrame([], kinds)
    for pack in range(packs if n else 0):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(packs)) == pack).orderBy("item_id", "term").toArrow().combine_chunks()
        if not own.num_rows:
            continue
        item, term = own.column("item_id").combine_chunks(), own.column("term").combine_chunks().dictionary_encode()
        starts = np.flatnonzero(np.diff(item.dictionary_encode("encode").indices.to_numpy(), prepend=-1))
        keys = item.take(pa.array(starts)).to_pylist()
        names, terms = term.dictionary.cast(pa.string()), term.indices.to_numpy().astype(np.int64)
        df = np.zeros(len(names), np.int64)
        for row in index.select("terms", "df").mapInArrow(_frequencies(names), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[row.term] = row.df
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        run = _search(keys, names, np.r_[starts, own.num_rows], terms, weight, int(n), int(total), k)
        found = found.unionByName(index.drop("n_docs", "n_tokens").mapInArrow(run, kinds))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
