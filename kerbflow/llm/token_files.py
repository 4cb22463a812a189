"""Token-ID files (operator 4).

Tokens are renumbered by their frequency in the corpus and coded in one to four bytes
each; a separate control stream holds two bits a token, its length less one.  A shard file
is laid out as follows, all numbers little-endian:

    b"KFTK" | u32 version | u64 documents | u64 tokens | u32 vocabulary
    vocabulary * u32  token id of each rank
    documents * i64   doc_id (the least value stands for null)
    documents * u32   tokens of each document
    ceil(tokens / 4)  control bytes, four tokens each, the first in the low bits
    data bytes

The decoder looks up the four lengths of each control byte in a table of 256 rows and
gathers the bytes with numpy, ``PIECE`` tokens at a time, so that reading a file needs its
bytes and little more.

Documents are dealt by ranges of (doc_id, hash of the text), so that a doc_id that many rows
share is split; a range is written as a row of files of about ``SHARD_TOKENS`` tokens.

Encoding keeps texts in Arrow buffers and hands every distinct piece to the tokenizer once a
slice.  Pieces are cut where the usual pattern of a byte-level BPE cuts anyway: before white space
that follows anything else, after a single line end or tab, and between letters, digits and
punctuation, as far as they are ASCII or Latin letters (an apostrophe stays with the letter after
it).  A piece of one kind, with or without a blank ahead, is one pre-token and goes to the
tokenizer's model at once; others take the way of a text.  Texts with white space beyond ASCII or
with a special token's string, and all texts if the tokenizer has another pattern, are encoded whole.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.llm import _text
from kerbflow.llm._cluster import bounded_batches, give_back, partitions, shared_folder, written

MAGIC, VERSION = b"KFTK", 1
#: Tokens coded at a time, a multiple of four.
PIECE = 1 << 18
#: Tokens after which a shard file is closed; only a single longer document makes a larger one.
SHARD_TOKENS = 1 << 22
#: Documents of a range, one task each.
RANGE_ROWS = 200_000
NULL_ID = np.iinfo(np.int64).min
#: Pieces that a worker remembers between slices, about 45 MB.
REMEMBERED = 1_200_000

#: Kinds of bytes; of those beyond ASCII only Latin letters of two bytes have one.
OTHER, LETTER, DIGIT, MARK, APOSTROPHE, SPACE = range(6)
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = MARK
_KIND[48:58] = DIGIT
_KIND[65:91] = _KIND[97:123] = LETTER
_KIND[39] = APOSTROPHE
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE
#: Whether a piece ends between two kinds.
_CUT = np.zeros((6, 6), bool)
_CUT[LETTER : APOSTROPHE + 1, LETTER : APOSTROPHE + 1] = ~np.eye(4, dtype=bool)
_CUT[MARK, APOSTROPHE] = _CUT[APOSTROPHE, MARK] = _CUT[APOSTROPHE, LETTER] = False
_CUT[:SPACE, SPACE] = True
#: Line ends and tabs, which are pieces of their own where they stand alone.
_LINE = np.zeros(256, bool)
_LINE[[9, 10, 13]] = True
#: The code point that stands for each byte in a byte-level vocabulary.
_SHOWN = np.arange(256, dtype="<u4")
_SHOWN[[*range(33), *range(127, 161), 173]] = 256 + np.arange(68)
#: Masks of the first bytes of a word of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ODD_SPACE = "[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of a sequence of ranks."""
    ranks = ranks.astype(np.uint32)
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    pad = np.concatenate([size - 1, np.zeros(-len(size) % 4, np.uint8)]).reshape(-1, 4).astype(np.uint8)
    control = pad[:, 0] | pad[:, 1] << 2 | pad[:, 2] << 4 | pad[:, 3] << 6
    used = np.arange(4) < size[:, None]
    return control.tobytes(), ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The ranks back, by table lookup of the lengths."""
    size = _LENGTHS[control].reshape(-1)[:count]
    start = np.cumsum(size, dtype=np.int64) - size
    out = data[start].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        out[more] |= data[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def shard_parts(doc_ids: np.ndarray, lengths: np.ndarray, ranks: np.ndarray, vocabulary: np.ndarray) -> list[bytes]:
    """The bytes of a shard file, in pieces; ranks are coded ``PIECE`` at a time."""
    head = MAGIC + struct.pack("<IQQI", VERSION, len(doc_ids), len(ranks), len(vocabulary))
    coded = [encode_ranks(ranks[a : a + PIECE]) for a in range(0, len(ranks), PIECE)]
    return [head, vocabulary.astype("<u4").tobytes(), doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), *(c for c, _ in coded), *(d for _, d in coded)]


def open_shard(raw: bytes) -> tuple[np.ndarray, np.ndarray, Iterator[np.ndarray]]:
    """doc_ids, tokens of each document, and the token ids of a shard file, ``PIECE`` at a time."""
    if raw[:4] != MAGIC:
        raise ValueError("not a token file")
    version, docs, tokens, size = struct.unpack_from("<IQQI", raw, 4)
    if version != VERSION:
        raise ValueError(f"token file version {version}")
    at = 4 + struct.calcsize("<IQQI")
    vocabulary = np.frombuffer(raw, "<u4", size, at)
    at += 4 * size
    doc_ids = np.frombuffer(raw, "<i8", docs, at)
    at += 8 * docs
    lengths = np.frombuffer(raw, "<u4", docs, at)
    at += 4 * docs
    control = np.frombuffer(raw, np.uint8, -(-tokens // 4), at)
    data = np.frombuffer(raw, np.uint8, -1, at + len(control))

    def pieces():
        used = 0
        for a in range(0, tokens, PIECE):
            count = min(PIECE, tokens - a)
            part = control[a // 4 : a // 4 + -(-count // 4)]
            size = int(_LENGTHS[part].reshape(-1)[:count].sum())
            yield vocabulary[decode_ranks(part, data[used : used + size], count)]
            used += size

    return doc_ids, lengths, pieces()


def read_shard(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, tokens of each document and all token ids of a shard file."""
    doc_ids, lengths, pieces = open_shard(raw)
    return doc_ids, lengths, np.concatenate([np.zeros(0, np.uint32), *pieces])


def by_document(lengths: np.ndarray, pieces: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """The ids of each document of a shard as a list of consecutive parts."""
    rest = np.zeros(0, np.uint32)
    for n in lengths.tolist():
        parts = []
        while n > len(rest):
            if len(rest):
                parts.append(rest)
            n -= len(rest)
            rest = next(pieces)
        parts.append(rest[:n])
        rest = rest[n:]
        yield parts


def _buffers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large binary array, and its offsets into them."""
    off = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def _kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8 texts."""
    kind = _KIND[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))  # U+00C0 to U+027F, letters but for two signs
    lead = lead[(data[lead] > 0xC3) | ((data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7))]
    kind[lead] = kind[lead + 1] = LETTER
    return kind


def _pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts in a row, and the texts' offsets into them."""
    data, off = _buffers(texts.cast(pa.large_binary()))
    if not len(data):
        return pa.array([], pa.large_binary()), off
    kind = _kinds(data)
    cut = np.empty(len(data), bool)
    cut[1:] = _CUT.reshape(-1)[kind[:-1] * np.uint8(6) + kind[1:]]
    cut[off[:-1][off[:-1] < len(data)]] = True
    line = np.flatnonzero(cut[:-1] & _LINE[data[:-1]])
    cut[line[kind[line + 1] != SPACE] + 1] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts, len(data)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]), np.searchsorted(starts, off)


def _keys(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each piece: a bijection of its bytes up to 16 of them, a hash beyond."""
    size = np.diff(off)
    words = np.ndarray(len(data) + 9, "<u8", np.append(data, np.zeros(16, np.uint8)), strides=(1,))
    low = words[np.minimum(off[:-1] + 8, len(data))] & _FIRST[np.clip(size - 8, 0, 8)]
    high = _text.mix((words[off[:-1]] & _FIRST[np.minimum(size, 8)]) ^ _text.mix(low))
    odd = np.flatnonzero((size > 16) | (data[off[1:] - 1] == 0))  # padding would hide a last zero
    if len(odd):
        hashes = [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(off[odd].tolist(), off[odd + 1].tolist())]
        high[odd], low[odd] = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2).T
    return high, low


class Remembered:
    """Ids of pieces by a key of 128 bits, in sorted arrays: some 40 bytes a piece."""

    def __init__(self):
        self.high, self.low, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint16), 0

    def find(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key's ids in ``start`` and ``count``, and whether there is one."""
        if not len(self.high):
            return np.zeros(len(high), np.int32), np.zeros(len(high), bool)
        at = np.searchsorted(self.high, high)
        while True:  # keys that share the high half follow one another
            near = np.minimum(at, len(self.high) - 1)
            same = self.high[near] == high
            known = same & (self.low[near] == low)
            further = same & ~known & (at < len(self.high))
            if not further.any():
                return self.slot[near], known
            at = at + further

    def add(self, high: np.ndarray, low: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Adds distinct unknown keys, their ids all in a row; returns their places."""
        if ids.dtype != self.ids.dtype and len(ids) and ids.max() >= 1 << 16:
            self.ids = self.ids.astype(np.uint32)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used // 2 + 2 * len(ids), self.ids.dtype)])
        self.ids[self.used : self.used + len(ids)] = ids
        slots = np.arange(len(self.start), len(self.start) + len(high), dtype=np.int32)
        self.start = np.append(self.start, (self.used + np.cumsum(count) - count).astype(np.int32))
        self.count = np.append(self.count, count.astype(np.int32))
        self.used += len(ids)
        order = np.argsort(high)
        at = np.searchsorted(self.high, high[order])
        for name, new in (("low", low), ("slot", slots), ("high", high)):
            setattr(self, name, np.insert(getattr(self, name), at, new[order]))
        return slots


class Encoder:
    """Encodes Arrow arrays of texts; one in each worker."""

    _made: dict = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            cutter = json.load(f).get("pre_tokenizer") or {}
        self.usual = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space", True)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Remembered()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and each text's count."""
        flat, count = [np.zeros(0, np.uint32)], []
        for a in range(0, len(texts), 10_000):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts[a : a + 10_000], add_special_tokens=False)]
            count += map(len, found)
            flat.append(np.fromiter(chain.from_iterable(found), np.uint32))
        return np.concatenate(flat), np.array(count, np.int64)

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """The numbers of the texts that must not be cut."""
        if not self.usual:
            return np.arange(len(texts))
        whole = pa.compute.match_substring_regex(texts, _ODD_SPACE)
        for t in self.special:
            whole = pa.compute.or_(whole, pa.compute.match_substring(texts, t))
        return np.flatnonzero(whole.to_numpy(zero_copy_only=False))

    def _piece_ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some pieces in a row and each piece's count."""
        kind = _kinds(data)
        kind[kind == APOSTROPHE] = MARK
        first = off[:-1] + ((data[off[:-1]] == 32) & (np.diff(off) > 1))
        change = np.concatenate([[0], np.cumsum(kind[1:] != kind[:-1])])
        one = np.isin(kind[first], (LETTER, DIGIT, MARK)) & (change[first] == change[off[1:] - 1])
        shown, cuts, model = _SHOWN[data].tobytes().decode("utf-32-le"), off.tolist(), self.tokenizer.model
        found = [[t.id for t in model.tokenize(shown[a:b])] if plain else None for a, b, plain in zip(cuts, cuts[1:], one.tolist())]
        rest, raw = np.flatnonzero(~one).tolist(), data.tobytes()
        for a in range(0, len(rest), 10_000):
            part = rest[a : a + 10_000]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([raw[cuts[k] : cuts[k + 1]].decode() for k in part], add_special_tokens=False)):
                found[k] = e.ids
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where the ids of distinct pieces are remembered; new pieces are encoded."""
        data, off = _buffers(pieces)
        high, low = _keys(data, off)
        if len(self.known.high) + len(pieces) > REMEMBERED:
            self.known = Remembered()
        place, known = self.known.find(high, low)
        new = np.flatnonzero(~known)
        if len(new):
            place[new] = self.known.add(high[new], low[new], *self._piece_ids(*_buffers(pieces.take(pa.array(new)))))
        return place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and each text's count; a null text is empty."""
        texts = texts.fill_null("")
        apart = self._whole(texts).tolist()
        spared = {k: self._ids([texts[k].as_py()])[0] for k in apart}
        if apart:
            empty = np.zeros(len(texts), bool)
            empty[apart] = True
            texts = pa.compute.if_else(pa.array(empty), "", texts)
        pieces, off = _pieces(texts)
        coded = pieces.dictionary_encode()
        place = self._places(coded.dictionary)[coded.indices.to_numpy()] if len(pieces) else np.zeros(0, np.int32)
        each = self.known.count[place]
        total = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        kind = np.int32 if total[-1] < 1 << 31 else np.int64
        at = np.repeat(self.known.start[place].astype(kind) - total[:-1].astype(kind), each)
        at += np.arange(total[-1], dtype=kind)
        out = self.known.ids[at]
        total = total[off]
        if spared:
            rows = [out[a:b] for a, b in zip(total[:-1], total[1:])]
            for k, v in spared.items():
                rows[k] = v
            return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)
        return out, np.diff(total)


def _encoded(tokenizer: str, end_id: int):
    def run(batches):
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            for part in _text.slices(batch):
                ids, count = encoder.encode(part.column("text"))
                off = np.concatenate([[0], np.cumsum(count)])
                packed, same = [], []
                ends = off[1:] + np.arange(len(count))
                full = np.empty(len(ids) + len(count), np.promote_types(ids.dtype, np.min_scalar_type(end_id)))
                inner = np.ones(len(full), bool)
                inner[ends] = False
                full[ends], full[inner] = end_id, ids
                for a, b in zip(off[:-1] + np.arange(len(count)), ends + 1):
                    narrow = full[a:b]
                    narrow = narrow.astype("<u2" if narrow.itemsize <= 2 or narrow.max() < 1 << 16 else "<u4", copy=False).tobytes()
                    same.append(xxhash.xxh3_64_intdigest(narrow) - (1 << 63))
                    packed.append(bytes([len(narrow) // int(b - a)]) + pa.compress(narrow, "zstd", asbytes=True))
                yield pa.RecordBatch.from_arrays([_text.long_column(part, "doc_id"), pa.array(same, pa.int64()), pa.array(count + 1), pa.array(packed, pa.binary())], ["doc_id", "hash", "n", "packed"])

    return run


def released() -> None:
    """A worker that has encoded gives its memory back."""
    Encoder._made.clear()
    give_back()


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    width = packed[0]
    return np.frombuffer(pa.decompress(packed[1:], n * width, "zstd", asbytes=True), f"<u{width}").astype(np.uint32)


def _counted(batches):
    """A task's counts of each id."""
    released()
    seen = np.zeros(1, np.int64)
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            ids = np.concatenate([_unpacked(p, n) for n, p in zip(*(part.column(k).to_pylist() for k in (0, 1)))])
            count = np.bincount(ids, minlength=len(seen))
            count[: len(seen)] += seen
            seen = count
    ids = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(seen[ids])], ["id", "count"])


def _store(folder: str):
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    return fs.FileSystem.from_uri(folder)


def _name(root: str, bucket: int, part: int) -> str:
    return f"{root}/shard-{bucket:08d}-{part:06d}.kftk"


def _written_shards(folder: str, vocabulary):
    """Writes a partition's rows, in order, as files of about ``SHARD_TOKENS`` tokens; returns a manifest."""

    def run(batches):
        released()
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        bucket, manifest = TaskContext.get().partitionId(), []
        docs, parts, size = [], [], 0
        rank_of = vocabulary.value[1]

        def save():
            lengths = np.array([len(p) for p in parts], np.int64)
            named = np.array([NULL_ID if d is None else d for d in docs], np.int64)
            pieces = shard_parts(named, lengths, np.concatenate(parts), vocabulary.value[0])
            name = _name(root, bucket, len(manifest))
            draft = f"{name}.{uuid.uuid4().hex}"  # a lost or repeated attempt leaves the final name whole
            with store.open_output_stream(draft) as f:
                for piece in pieces:
                    f.write(piece)
            store.move(draft, name)
            manifest.append((bucket, len(manifest), len(docs), int(lengths.sum())))

        for batch in batches:
            for d, n, p in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if size and size + n > SHARD_TOKENS:
                    save()
                    docs, parts, size = [], [], 0
                docs.append(d)
                parts.append(rank_of[_unpacked(p.as_py(), n)])
                size += n
        if parts:
            save()
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in manifest], pa.int64()) for k in range(4)], ["bucket", "part", "docs", "tokens"])

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Writes token files below ``folder`` and returns their manifest (bucket, part, docs, tokens, base).

    Files follow one another in ascending doc_id order (nulls first), rows inside likewise; rows
    that share a doc_id are ordered by a hash of their ids.  ``base`` is the number of ids in the
    files before.  Null and empty texts hold the end id alone.  An empty table writes no file.
    The tokenizer must be a byte-level BPE: pieces are encoded on their own.
    """
    spark = docs.sparkSession
    checked_kind(tokenizer)
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = written(docs.mapInArrow(_encoded(tokenizer, end_id), "doc_id long, hash long, n long, packed binary"), "tokens")
    parts = max(partitions(spark), -(-ids.count() // range_rows))
    counts = ids.select("n", "packed").mapInArrow(_counted, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))
    ranked = counts.orderBy(F.desc("count"), "id").toPandas()  # as long as the tokenizer's vocabulary
    by_rank = ranked["id"].to_numpy(np.int64)
    narrow = np.uint16 if len(by_rank) < 1 << 16 else np.uint32
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, narrow)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=narrow)
    vocabulary = spark.sparkContext.broadcast((by_rank.astype(np.uint32), rank_of))
    again = ids.repartitionByRange(parts, "doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    manifest = written(again.mapInArrow(_written_shards(folder, vocabulary), "bucket long, part long, docs long, tokens long"), "manifest")
    before = Window.orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def checked_kind(tokenizer: str) -> None:
    """Raises unless the file describes a byte-level BPE without a normalizer."""
    with open(tokenizer, encoding="utf-8") as f:
        told = json.load(f)
    kinds = json.dumps(told.get("pre_tokenizer") or {})
    if (told.get("model") or {}).get("type") != "BPE" or "ByteLevel" not in kinds or told.get("normalizer"):
        raise ValueError(f"{tokenizer}: only byte-level BPE tokenizers without a normalizer can be encoded by pieces")


def _files(manifest: DataFrame) -> DataFrame:
    return manifest.select("bucket", "part", "base").repartition(partitions(manifest.sparkSession), "bucket", "part")


def _documents(folder: str, row_of):
    """Rows of all documents of some files; ``row_of`` makes the last columns of a document's parts."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), *row_of.kinds]

    def run(batches):
        released()
        store, root = _store(folder)
        for batch in batches:
            for bucket, part, base in zip(*(batch.column(k).to_pylist() for k in range(3))):
                with store.open_input_stream(_name(root, bucket, part)) as f:
                    doc_ids, lengths, pieces = open_shard(f.read())
                out, size = [], 0
                for doc, n, parts in zip(doc_ids.tolist(), lengths.tolist(), by_document(lengths, pieces)):
                    out.append((None if doc == NULL_ID else doc, base, n, *row_of(parts)))
                    base, size = base + n, size + n
                    if size > PIECE or len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [f"c{k}" for k in range(len(kinds))])
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [f"c{k}" for k in range(len(kinds))])

    return run


def _crc(parts: list[np.ndarray]) -> tuple:
    """The crc of a document's ids, as little-endian unsigned 32-bit integers."""
    value = 0
    for p in parts:
        value = zlib.crc32(np.ascontiguousarray(p, "<u4"), value)
    return (value,)


def _crc_and_ids(parts: list[np.ndarray]) -> tuple:
    return (*_crc(parts), b"".join(np.ascontiguousarray(p, "<u4").tobytes() for p in parts))


_crc.kinds, _crc_and_ids.kinds = [pa.int64()], [pa.int64(), pa.binary()]


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of each document, from the files.

    ``ids`` are little-endian unsigned 32-bit integers.
    """
    return _files(manifest).mapInArrow(_documents(folder, _crc_and_ids), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def token_digest(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row of ``docs``, read back from the files.

    Null and empty texts are documents of the end id alone; an empty table gives no rows.
    Repeated rows are documents each; rows that share a doc_id start in the order of a hash of
    their ids, so reruns agree.  Further columns, whatever their names, are ignored.
    """
    folder = shared_folder(docs.sparkSession, "token-files")
    manifest = write_token_files(docs, folder, tokenizer, end_id)
    return _files(manifest).mapInArrow(_documents(folder, _crc), "doc_id long, start long, n_tokens long, ids_crc32 long")
