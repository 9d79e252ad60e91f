"""Helpers shared by the corpus operators: Arrow text access, word hashing, shared folders, small mixers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the corpus contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a vectorised kernel looks at in one go.
CHUNK_BYTES = 1 << 20

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over unsigned 64-bit integers."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes: texts can be long, and a batch lies whole in a Python worker.

    All operators set the same values, so it does not matter which of them ran last when a lazy result is read.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def columns(docs: DataFrame, **wanted: str) -> DataFrame:
    """The wanted columns (new name = name in docs) and no others, found by exact name: what else docs holds, whatever
    its name, cannot clash."""
    places = {new: docs.columns.index(old) for new, old in wanted.items()}
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).select(*(F.col(f"c{i}").alias(new) for new, i in places.items()))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share; only a local master may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the folders of materialised tables that no plan reads any more, through the file systems that Spark knows."""
    for t in tables:
        spark = t.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs written once with a row number in the column row, and the private names (c0, c1 ...) of its columns.

    Every later step reads rows and numbers from that table, so it does not matter how often, or on how many executors,
    docs itself would be read again.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    return materialise(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "rows"), names


def file_system(uri: str):
    """The pyarrow file system and path of a URI or plain path."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices_by_bytes(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column whose bytes stay near the limit; one row alone may exceed it."""
    size = np.diff(offsets_of(column)).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(size):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n) + 1
    if start < len(column):
        yield start, len(column)


def offsets_of(column: pa.Array) -> np.ndarray:
    """Byte offsets of a (large) string or binary column, nulls being empty."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(1, kind)
    raw = np.frombuffer(column.buffers()[1], kind, count=len(column) + 1 + column.offset)
    return raw[column.offset :]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and each row's offsets into them, rows being contiguous."""
    off = offsets_of(column).astype(np.int64)
    data = column.buffers()[2]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        step = _POWERS[-1] * _BASE
        _POWERS = np.concatenate([_POWERS, _POWERS * step])
    return _POWERS[:n]


_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_INVERSES = np.ones(1, np.uint64)


def _inverses(n: int) -> np.ndarray:
    global _INVERSES
    while len(_INVERSES) < n:
        step = _INVERSES[-1] * _INVERSE
        _INVERSES = np.concatenate([_INVERSES, _INVERSES * step])
    return _INVERSES[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, and the index of each row's first word (one more at the end).

    A word's hash is a polynomial over random byte values, taken as a difference of prefix sums and mixed.
    """
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    head = np.zeros(len(data), bool)
    head[offsets[:-1][offsets[:-1] < len(data)]] = True  # a row's first byte starts a word even after a letter
    before = np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(~space & (before | head))
    after = np.concatenate([space[1:] | head[1:], [True]])
    ends = np.flatnonzero(~space & after) + 1
    with np.errstate(over="ignore"):
        terms = _BYTE_VALUES[_LOWER[data]] * _powers(len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        h = mix64((sums[ends] - sums[starts]) * _inverses(len(data) + 1)[starts])
    return h, np.searchsorted(starts, offsets)


def byte_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's bytes."""
    with np.errstate(over="ignore"):
        terms = _BYTE_VALUES[data] * _powers(len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        return mix64((sums[offsets[1:]] - sums[offsets[:-1]]) * _inverses(len(data) + 1)[offsets[:-1]])


def set_shingles(words: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's n-word shingles and the index of its first; a row of fewer words has one, of none none."""
    count = np.diff(first)
    out_n = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    start = np.concatenate([[0], np.cumsum(out_n)])
    row = np.repeat(np.arange(len(count)), out_n)
    at = first[row] + (np.arange(start[-1]) - start[row])
    width = np.minimum(count[row], n)
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            take = k < width
            w = words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else words
            h = np.where(take, mix64(h * _MIX1 + w), h)
    return h, start


def crc_fold(name: str, divisor: int):
    """crc32 of the id as text, modulo the divisor: the fold column of the learning contracts."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % divisor


def join_spread(big: DataFrame, small: DataFrame, on: str | list[str], n: str, value: str) -> DataFrame:
    """Left join of big with small (on, n, value), small having one row per key and n big's rows of it; on: long columns.

    Keys with more than a 2000th of all rows (so fewer than 2000 of them) are looked up by broadcast, and their rows
    dealt out in the shuffle by a hash of the whole row, so no key lands in one task and a repeated attempt deals alike.
    The value column is added to big. small must be a written table, as it is read several times.
    """
    on = [on] if isinstance(on, str) else on
    total = small.agg(F.sum(n)).first()[0] or 0
    heavy = small.where(F.col(n) > max(1000, total // 2000)).select(*(F.col(k).alias(f"_h{i}") for i, k in enumerate(on)), F.col(value).alias("_hv"), F.lit(True).alias("_hot"))
    light = small.select(*(F.col(k).alias(f"_l{i}") for i, k in enumerate(on)), F.col(value).alias("_lv"))
    same = lambda side: [F.col(k) == F.col(f"{side}{i}") for i, k in enumerate(on)]
    dealt = big.join(F.broadcast(heavy), same("_h"), "left").withColumn("_salt", F.when(F.col("_hot"), F.xxhash64(*(F.col(c) for c in big.columns))).otherwise(F.col(on[0])))
    joined = dealt.join(light, [F.col("_salt") == F.col("_l0"), *same("_l")[1:]], "left")
    return joined.select(*big.columns, F.when(F.col("_hot"), F.col("_hv")).otherwise(F.col("_lv")).alias(value))


def bounded_sample(rows: DataFrame, by: str, bounds: dict, counts: dict) -> DataFrame:
    """At most bounds[v] distinct rows (by, id, text) of each value v of `by`, chosen by a hash of id and text.

    counts holds how many rows each value has. Rows are first thinned by their hash to half as many again as the bound, so
    the table written on the way is bounded too, then cut at the bound's last hash; repeated rows count once. Adds turn,
    the hash.
    """
    turned = rows.withColumn("turn", F.xxhash64("id", "text"))
    share = lambda v: min(1.0, 1.5 * bounds[v] / max(counts[v], 1))
    few = F.lit(False)
    for v in counts:
        few = few | ((F.col(by) == F.lit(v)) & (F.pmod("turn", F.lit(1 << 30)) < int(share(v) * (1 << 30))))
    thin = materialise(turned.where(few).dropDuplicates([by, "turn"]), "thinned")
    kept = F.lit(False)
    for v in counts:  # the bound's last hash, so that no task has to order the rows themselves
        last = thin.where(F.col(by) == F.lit(v)).select("turn").orderBy("turn").limit(bounds[v]).agg(F.max("turn")).first()[0]
        kept = kept | ((F.col(by) == F.lit(v)) & (F.col("turn") <= F.lit(last)))
    sample = materialise(thin.where(F.coalesce(kept, F.lit(False))), "sample")
    discard(thin)
    return sample
