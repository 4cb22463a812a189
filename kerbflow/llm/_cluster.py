"""Helpers for jobs that run in several steps on a cluster."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbflow.operators.graph import star_components


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset (local
    tests) a temporary folder is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="kerbflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once, as a Parquet table in the shared folder; cuts the lineage."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of an Arrow batch on its way to a Python task.
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keeps the Arrow batches of this session small: a batch of ten thousand long texts does not fit a small worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    told = re.fullmatch(r"(-?\d+)([kmgt]?)b?", spark.conf.get(name, "64m").strip().lower())
    now = int(told[1]) << 10 * " kmgt".index(told[2] or " ") if told else 0
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def set_aside(df: DataFrame, names) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the columns of these names renamed, and how to name them back (``withColumnsRenamed``)."""
    back = {f"__own_{c}": c for c in df.columns if c in names}
    return df.withColumnsRenamed({c: own for own, c in back.items()}), back


def give_back() -> None:
    """A Python worker that later stages reuse returns what it no longer needs to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 128 << 20


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast only if it is counted to hold few rows, and few bytes of strings."""
    size = F.lit(0)
    for c, kind in df.dtypes:
        if kind in ("string", "array<string>"):
            size = size + F.coalesce(F.octet_length(F.col(c) if kind == "string" else F.array_join(c, "")), F.lit(0))
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= BROADCAST_BYTES else df


SLICES = 16


def sketch_rows(counts: np.ndarray) -> tuple[list[int], list[bytes]]:
    """A partition's counters as ``SLICES`` compressed pieces."""
    pieces = counts.astype("<u4").reshape(SLICES, -1)
    found = [k for k in range(SLICES) if pieces[k].any()]
    return found, [pa.compress(pieces[k].tobytes(), "zstd", asbytes=True) for k in found]


def merged_sketch(rows: DataFrame, cells: int) -> np.ndarray:
    """Sums the counters of ``sketch_rows`` (columns slice, part), piece by piece in tasks.

    Only the ``cells`` sums reach the driver, however large the corpus.
    """
    width = cells // SLICES

    def add(batches):
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                piece = np.frombuffer(pa.decompress(part, width * 4, "zstd", asbytes=True), "<u4")
                have[k] = have[k] + piece if k in have else piece.astype(np.uint64)
        if have:
            packed = [pa.compress(np.minimum(v, 0xFFFFFFFF).astype("<u4").tobytes(), "zstd", asbytes=True) for v in have.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array(packed, pa.binary())], ["slice", "part"])

    kind = "slice int, part binary"
    total = rows.select("slice", "part").mapInArrow(add, kind).repartition(SLICES, "slice").mapInArrow(add, kind)
    out = np.zeros((SLICES, width), np.uint32)
    for row in total.collect():
        out[row.slice] = np.frombuffer(pa.decompress(row.part, width * 4, "zstd", asbytes=True), "<u4")
    return out.reshape(-1)


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a long, b long): (node, component), the least node."""
    return star_components(links, lambda df: written(df, "links"))
