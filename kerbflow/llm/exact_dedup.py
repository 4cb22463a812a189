"""Exact duplicates against a historical index (operator 11).

The history's distinct text digests are dealt into shards of about ``SHARD_KEYS``.  A shard is
one row of the index table: a minimal perfect hash of its digests (a cascade of bit arrays:
every digest that is alone on its bit keeps it, the others go to the next array; a digest's slot
is the rank of its bit) and, slot by slot, the full digest, the doc_id of the row that stays
and how many rows had it.  New digests are aggregated first, then meet their shard in blocks of
at most about ``PROBE_KEYS``; a slot counts only if all 32 bytes of its digest are those looked
up.  Digests without a slot of their own are grouped among themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbflow.llm._cluster import set_aside, sized, written
from kerbflow.llm._text import mix

BLANKS = r"[\x20\x09-\x0D]+"
SHARD_KEYS = 1 << 16
PROBE_KEYS = 1 << 18
#: Bits of an array of the cascade for each digest that is still without a slot.
GAMMA = 2
#: Groups of at least a share 1 / HEAVY of all rows, of which there are at most HEAVY, are broadcast to their rows.
HEAVY = 1000
INDEX = "shard int, levels array<binary>, digests binary, winners array<bigint>, copies array<bigint>"


def digest(text) -> F.Column:
    """SHA-256 of a text in which each run of white space is one space; a null text counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " "), 256))


class PerfectHash:
    """A minimal perfect hash of distinct 32-byte digests, given as rows of four 64-bit words."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.rank, base = [], 0
        for bits in levels:
            count = np.cumsum(bits, dtype=np.int64)
            self.rank.append(base + count - 1)
            base += int(count[-1])

    @staticmethod
    def _seat(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(keys[:, level % 4] + np.uint64(level)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            size = 8 * -(-GAMMA * len(keys) // 8)
            seat = cls._seat(keys, len(levels), size)
            alone = np.bincount(seat, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[seat]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot of each member; of a digest that is none, some slot or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.levels, self.rank)):
            seat = self._seat(keys[left], level, len(bits))
            hit = bits[seat]
            out[left[hit]] = rank[seat[hit]]
            left = left[~hit]
        return out


def _words(digests: pa.Array) -> np.ndarray:
    """The digests (32 bytes each) as rows of four 64-bit words."""
    return np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 4)


def _build(shard: tuple, table: pa.Table) -> pa.Table:
    keys = _words(table.column("digest").combine_chunks())
    found = PerfectHash.of(keys)
    order = np.argsort(found.slots(keys))
    bits = [np.packbits(x).tobytes() for x in found.levels]
    row = [[shard[0].as_py()], [bits], [keys[order].tobytes()], [table.column("first").take(order).to_pylist()], [table.column("n").take(order).to_pylist()]]
    kinds = [pa.int32(), pa.list_(pa.binary()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.table([pa.array(x, kind) for x, kind in zip(row, kinds)], ["shard", "levels", "digests", "winners", "copies"])


def _shard(shards: int) -> F.Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")


def build_index(history: DataFrame) -> tuple[DataFrame, int]:
    """The index table of ``history`` (digest, first, n; one row a digest), and its number of shards."""
    shards = max(1, -(-history.count() // SHARD_KEYS))
    found = history.select(_shard(shards), "digest", "first", "n").groupBy("shard").applyInArrow(_build, INDEX)
    return written(found, "index"), shards


def _probe(key: tuple, probes: pa.Table, shard: pa.Table) -> pa.Table:
    n = probes.num_rows
    winner, member = pa.nulls(n, pa.int64()), np.zeros(n, bool)
    if n and shard.num_rows:
        row = shard.slice(0, 1).to_pylist()[0]
        keys, stored = _words(probes.column("digest").combine_chunks()), np.frombuffer(row["digests"], "<u8").reshape(-1, 4)
        levels = [np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for x in row["levels"]]
        slot = PerfectHash(levels).slots(keys)
        member = (slot >= 0) & (stored[slot] == keys).all(axis=1)
        winner = pa.array(row["winners"], pa.int64()).take(pa.array(slot, mask=~member))
    return pa.table([probes.column("digest"), probes.column("first"), probes.column("n"), pa.array(member), winner], ["digest", "first", "n", "member", "winner"])


def look_up(index: DataFrame, shards: int, probes: DataFrame) -> DataFrame:
    """``probes`` (digest, first, n; one row a digest) with ``member`` and the ``winner`` in its slot."""
    salts = max(1, -(-probes.count() // (shards * PROBE_KEYS)))
    left = probes.select(_shard(shards), F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(salts)).cast("int").alias("salt"), "digest", "first", "n")
    right = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "levels", "digests", "winners")
    return left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInArrow(_probe, "digest binary, first long, n long, member boolean, winner long")


def exact_groups(docs: DataFrame, history: F.Column) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, keep_id, group_size, kept, text_sha256, historical.

    Rows for which ``history`` holds are the history.  Of its equal texts the row with the least
    doc_id stays and goes into the index; a new row whose text is in the index goes, whatever its
    doc_id.  Of other equal texts the new row with the least doc_id stays.  A row without doc_id stays only if no row of its kind
    has one, keep_id is null then.  Of repeated rows (same doc_id and text) one stays.  Null and
    empty texts are equal; a text of white space alone equals one space.  Empty tables give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"), F.coalesce(history, F.lit(False)).alias("historical"))
    rows = written(rows.groupBy("digest", "doc_id", "historical").agg(F.count("*").alias("n")), "digests")
    each = rows.groupBy("digest", "historical").agg(F.min("doc_id").alias("first"), F.sum("n").alias("n"))
    each = written(each, "distinct")
    old = each.where("historical").select("digest", "first", "n")
    index, shards = build_index(old)
    new = look_up(index, shards, each.where("not historical").select("digest", "first", "n"))
    groups = old.withColumn("member", F.lit(True)).unionByName(new.select("digest", F.when(F.col("member"), F.col("winner")).otherwise(F.col("first")).alias("first"), "n", "member"))
    groups = groups.groupBy("digest").agg(F.min("first").alias("keep_id"), F.sum("n").alias("group_size"), F.max("member").alias("__old"))
    groups = written(groups, "groups")

    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    large = F.col("group_size") * HEAVY >= max(total, HEAVY)
    heavy, light = F.broadcast(groups.where(large)), groups.where(~large)
    found = rows.join(heavy, "digest").unionByName(rows.join(F.broadcast(groups.where(large).select("digest")), "digest", "left_anti").join(light.hint("merge"), "digest"))
    first = (F.col("historical") == F.col("__old")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    found = found.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return found.select("doc_id", "keep_id", "group_size", (first & (F.col("__copy") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "historical")


def unique_documents(docs: DataFrame, history: F.Column) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see ``exact_groups``.

    Of rows that repeat doc_id and text but differ in other columns any one stays.
    """
    docs, back = set_aside(docs, ("__digest", "__kept_id", "__rows"))
    groups = exact_groups(docs, history)
    kept = groups.groupBy(F.unhex("text_sha256").alias("__kept_digest"), F.col("doc_id").alias("__kept_id")).agg(F.max("kept").alias("kept"), F.count("*").alias("__rows"))
    kept = written(kept.where("kept"), "kept")
    own = docs.withColumn("__digest", digest(F.col("text")))
    same = (F.col("__digest") == F.col("__kept_digest")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__kept_id"))
    single = own.join(kept.where("__rows = 1").hint("merge"), same, "left_semi")
    several = own.join(sized(kept.where("__rows > 1")), same, "left_semi").dropDuplicates(["doc_id", "__digest"])
    return single.unionByName(several).drop("__digest").withColumnsRenamed(back)
