"""Token-ID output: raw id shards with a minimal perfect hash index for constant-time keyed access.

A shard is two files. `<shard>.ids` holds little-endian unsigned ids (of 16 bits where the vocabulary fits, else of 32),
documents one after another in key order.
`<shard>.idx` holds a JSON header line and raw arrays: the levels of the perfect hash, and by hash slot a key
fingerprint, the document's first id and its number of ids; last, the keys in file order.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, file_system, mix64, n_partitions, shared_dir, slices_by_bytes, small_batches
from .tokens import encoder

_LEVELS = 48
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def key_hash(keys: np.ndarray, nulls: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """A 64-bit hash of a document key (or null) and of its turn among equal keys of the shard."""
    with np.errstate(over="ignore"):
        return mix64(mix64(keys.astype(np.int64).view(np.uint64) + nulls.astype(np.uint64) * _NONE) + turn.astype(np.uint64))


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit values: at each level, values that meet no other set a bit, and the
    rest go on; a value's slot is the rank of its bit."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray) -> None:
        self.sizes, self.words = sizes.astype(np.int64), words.astype(np.uint64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.ranks = np.cumsum(ones) - ones

    @staticmethod
    def _bit(h: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix64(h + np.uint64(level + 1) * np.uint64(0xA24BAED4963EE407)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, h: np.ndarray) -> "PerfectHash":
        sizes, bits = [], []
        for level in range(_LEVELS):
            if not len(h):
                break
            size = max(64, -(-2 * len(h) // 64) * 64)
            at = cls._bit(h, level, size)
            count = np.bincount(at, minlength=size)
            sizes.append(size)
            bits.append(count == 1)
            h = h[count[at] > 1]
        if len(h):
            raise ValueError("equal hashes among the keys of a shard")
        packed = np.packbits(np.concatenate(bits), bitorder="little").view(np.uint64) if bits else np.zeros(0, np.uint64)
        return cls(np.array(sizes, np.int64), packed)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """Each value's slot; values that were not built in get any slot or -1."""
        out, open_ = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            bit = self.starts[level] + self._bit(h[open_], level, int(size))
            word, inside = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> inside) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << inside[hit]) - np.uint64(1))
            out[open_[hit]] = self.ranks[bit[hit] >> 6] + np.bitwise_count(below).astype(np.int64)
            open_ = open_[~hit]
        return out


def fingerprints(h: np.ndarray) -> np.ndarray:
    return (mix64(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


#: Bytes of text that a shard is meant for.
SHARD_BYTES = 128 << 20


def turns(keys: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... within each run of equal keys."""
    if not len(keys):
        return np.zeros(0, np.int64)
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (nulls[1:] != nulls[:-1])])
    first = np.flatnonzero(new)
    return np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, spaces: str = "kept", key: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Encode whole texts and write them as shards in ascending key order; returns one manifest row per shard.

    Null keys come first, null texts are empty (just the end id), rows of equal keys stay apart as turns of that key.
    Equal keys are ordered by a hash of the text, so that a very frequent key spreads over shards. Very long texts are
    encoded whole, one at a time. There are as many shards as shuffle partitions, and more where a shard would hold more
    than SHARD_BYTES of text, since a task holds the index of its shard. Runs at once; the manifest (shard, documents,
    tokens) holds one row per shard and is small.
    """
    spark = docs.sparkSession
    small_batches(spark)
    given = columns(docs, k=key, t=text).select(F.col("k").cast("long").alias("k"), F.col("t").cast("string").alias("t"))
    if not shards:
        size = given.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        shards = max(n_partitions(spark), -(-size // SHARD_BYTES))
    sorted_docs = (
        given.select("k", "t", F.xxhash64("t").alias("o"))
        .repartitionByRange(shards, "k", "o")
        .sortWithinPartitions("k", "o")
        .select("k", "t")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, mine = f"shard-{task.partitionId():06d}", f".{task.taskAttemptId()}.tmp"
        fs, root = file_system(path)
        coder, keys, nulls, sizes = encoder(tokenizer, spaces), [], [], []
        kind = "<u2" if max(end_id, len(coder.opens) - 1) < 1 << 16 else "<u4"
        fs.create_dir(root, recursive=True)
        end = np.array([end_id], "<u4")
        with fs.open_output_stream(f"{root}/{name}.ids{mine}") as sink:
            for batch in batches:
                for a, b in slices_by_bytes(batch.column(1), 4 << 20):
                    part = batch.slice(a, b - a)
                    ids, start = coder.encode(part.column(1))
                    n = np.diff(start)
                    sink.write(np.insert(ids, start[1:], end[0]).astype(kind).tobytes())
                    keys.append(np.asarray(part.column(0).fill_null(0), np.int64))
                    nulls.append(np.asarray(part.column(0).is_null()))
                    sizes.append(n + 1)
        k, z, n = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.int64), (nulls, bool), (sizes, np.int64)))
        h = key_hash(k, z, turns(k, z))
        perfect = PerfectHash.build(h)
        slot = perfect.slots(h)

        def place(values: np.ndarray, kind: type) -> np.ndarray:
            out = np.zeros(len(k), kind)
            out[slot] = values
            return out

        arrays = {"sizes": perfect.sizes, "words": perfect.words, "fingerprint": place(fingerprints(h), np.uint32), "start": place(np.cumsum(n) - n, np.int64), "length": place(n, np.int64), "key": k, "null": z.astype(np.uint8)}
        head = json.dumps({"format": 1, "ids": kind, "arrays": [[a, v.dtype.str, len(v)] for a, v in arrays.items()]})
        with fs.open_output_stream(f"{root}/{name}.idx{mine}") as sink:
            sink.write(head.encode() + b"\n" + b"".join(v.tobytes() for v in arrays.values()))
        for kind in ("ids", "idx"):  # attempts of one task write the same content, so the last may win
            fs.move(f"{root}/{name}.{kind}{mine}", f"{root}/{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"shard": [name], "documents": [len(k)], "tokens": [int(n.sum())]})

    return sorted_docs.mapInArrow(write, "shard string, documents long, tokens long")


class Shard:
    """Keyed access to one shard; reads the payload in blocks."""

    def __init__(self, path: str, name: str, block: int = 8 << 20) -> None:
        fs, root = file_system(path)
        with fs.open_input_stream(f"{root}/{name}.idx") as f:
            raw = f.read()
        head, _, body = raw.partition(b"\n")
        head, at = json.loads(head), 0
        for a, kind, n in head["arrays"]:
            v = np.frombuffer(body, np.dtype(kind), n, at)
            setattr(self, a, v)
            at += v.nbytes
        self.kind = np.dtype(head["ids"])
        self.perfect = PerfectHash(self.sizes, self.words)
        self.file, self.block, self.held = fs.open_input_file(f"{root}/{name}.ids"), block, (0, b"")

    def find(self, keys: np.ndarray, nulls: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id and number of ids of each key; -1 where the fingerprint says that the shard lacks it."""
        h = key_hash(keys, nulls, turn)
        slot = self.perfect.slots(h)
        ok = slot >= 0
        ok[ok] = self.fingerprint[slot[ok]] == fingerprints(h[ok])
        safe = np.where(ok, slot, 0)
        return (np.where(ok, self.start[safe], -1), np.where(ok, self.length[safe], -1)) if len(self.start) else (slot, slot)

    def ids(self, start: int, length: int) -> np.ndarray:
        """The ids of a document, as unsigned 32-bit integers."""
        a, n = self.kind.itemsize * int(start), self.kind.itemsize * int(length)
        at, data = self.held
        if not at <= a <= a + n <= at + len(data):
            self.file.seek(a)
            self.held = at, data = a, self.file.read(max(n, self.block))
        return np.frombuffer(data, self.kind, int(length), a - at).astype("<u4")

    def get(self, key: int, turn: int = 0) -> np.ndarray | None:
        start, n = self.find(np.array([key]), np.zeros(1, bool), np.array([turn]))
        return None if n[0] < 0 else self.ids(start[0], n[0])


def read_shards(manifest: DataFrame, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    rows = sorted(manifest.collect())  # one row per shard
    before = np.cumsum([0, *(r.tokens for r in rows)]).tolist()
    listed = spark.createDataFrame([(r.shard, b) for r, b in zip(rows, before)], "shard string, base long").repartition(max(1, len(rows)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(path, name)
                nulls = shard.null.astype(bool)
                start, n = shard.find(shard.key, nulls, turns(shard.key, nulls))
                for a in range(0, len(n), 20_000):
                    s, m = start[a : a + 20_000], n[a : a + 20_000]
                    crc = [zlib.crc32(shard.ids(x, y)) for x, y in zip(s.tolist(), m.tolist(), strict=True)]
                    keys = pa.array(shard.key[a : a + 20_000], pa.int64(), mask=nulls[a : a + 20_000])
                    yield pa.RecordBatch.from_arrays([keys, pa.array(s + base), pa.array(m), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_index(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the shards of docs to a shared folder, read them back, and return what the files hold of each document.

    Empty tables give no rows; further columns of docs play no part.
    """
    path = path or shared_dir(docs.sparkSession, "token-shards")
    spark = docs.sparkSession
    rows = write_shards(docs, path, tokenizer, end_id).collect()
    return read_shards(spark.createDataFrame(rows, "shard string, documents long, tokens long"), path)
