"""Approximate nearest neighbours with a permutation index.

Pivots are drawn from a bounded sample. A vector is represented by its nearest pivots in order; each block of vectors
posts them in pivot inverted files, with the pivot's place. A query adds up its footrule agreement with the vectors
posted under its own pivots, and the best ranked are reranked by their exact cosine, going on as long as a further part
of the ranking still changes the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .vectors import packed_vectors, stack, vector_kind

_SCHEMA = "query_id long, vec_id long, score double"


class PivotFiles:
    """Pivot inverted files over the unit vectors of a block."""

    def __init__(self, unit: np.ndarray, pivots: np.ndarray, length: int) -> None:
        self.pivots, self.length, self.rows = pivots, length, len(unit)
        order = self.order(unit)
        place = np.tile(np.arange(length), len(unit))
        row = np.repeat(np.arange(len(unit)), length)
        by_pivot = np.lexsort((row, order.ravel()))
        cut = np.searchsorted(order.ravel()[by_pivot], np.arange(len(pivots) + 1))
        self.files = [(row[by_pivot[a:b]], place[by_pivot[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def order(self, unit: np.ndarray) -> np.ndarray:
        """The nearest pivots of each vector, nearest first."""
        return np.argsort(-(unit @ self.pivots.T), axis=1, kind="stable")[:, : self.length]

    def agreement(self, order: np.ndarray) -> np.ndarray:
        """For each vector of the block a number that falls as its footrule distance to the query grows: pivots that
        both hold count length - max(place, place), which is the footrule with missing pivots placed last."""
        total = np.zeros(self.rows, np.int64)
        for mine, p in enumerate(order.tolist()):
            row, place = self.files[p]
            total[row] += self.length - np.maximum(place, mine)
        return total


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, length: int, share: float, least: int, k: int) -> list[tuple[int, int, float]]:
    """(query, vector, cosine) of the k nearest found of each query in a block, the query's own row aside."""
    norm = np.linalg.norm(vectors, axis=1)
    files = PivotFiles(vectors / norm[:, None], pivots, length)
    q_norm = np.linalg.norm(queries, axis=1)
    orders = files.order(queries / q_norm[:, None])
    step = max(least, int(share * len(ids)))
    out = []
    for qid, q, qn, order in zip(query_ids.tolist(), queries, q_norm, orders, strict=True):
        ranking = np.argsort(-files.agreement(order), kind="stable")
        best: list[tuple[float, int]] = []
        for a in range(0, len(ranking), step):
            part = ranking[a : a + step]
            part = part[ids[part] != qid]
            score = (vectors[part] * q).sum(1) / (norm[part] * qn)
            new = sorted([*best, *zip((-score).tolist(), ids[part].tolist(), strict=True)])[:k]
            if a and new == best:
                break
            best = new
        out += [(qid, i, -s) for s, i in best]
    return out


def nearest(rows: DataFrame, is_query: str, k: int = 5, pivots: int = 256, length: int = 96, share: float = 0.05, least: int = 500, block: int = 8192, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine, double) of the k nearest found, ties to the smaller vec_id.

    is_query is a predicate over id. Every valid row is indexed and a candidate of every query but itself; the pivots
    are a sample of fixed size. Of equal vectors, only the k + 1 of smallest id can be among any query's k nearest, so
    the others need no place in the index. Blocks of vectors meet blocks of queries; vectors of another length, and rows
    that are null, zero or hold null or non-finite components, take no part. Repeated rows count
    once; vectors that share an id are candidates of their own. An empty table gives no rows.
    """
    spark, kind = rows.sparkSession, vector_kind(rows, embedding)
    valid = materialise(packed_vectors(rows, key, embedding).where("vec is not null and id is not null").dropDuplicates(["id", "vec"]), "vectors")
    same = Window.partitionBy("vec").orderBy("id")
    indexed = materialise(valid.withColumn("turn", F.row_number().over(same)).where(F.col("turn") <= k + 1).drop("turn"), "indexed")
    queries = valid.where(is_query).dropDuplicates(["id"])
    n, m = indexed.count(), queries.count()
    chosen = indexed.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    by_dim: dict[int, list[np.ndarray]] = {}
    for r in chosen:
        v = np.frombuffer(bytes(r.vec), kind).astype(np.float64)
        by_dim.setdefault(r.dim, []).append(v / np.linalg.norm(v))
    shared = spark.sparkContext.broadcast({d: np.stack(v) for d, v in by_dim.items()})
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-m // block))
    left = indexed.select("dim", F.pmod(F.xxhash64("id", "vec"), F.lit(blocks).cast("long")).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("c"), "id", "vec")
    right = queries.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"), F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("c"), "id", "vec")

    def search(key_: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        dim = key_[0].as_py()
        pivot = shared.value.get(dim)
        found = []
        if a.num_rows and b.num_rows:
            data, asked = stack(a.column("vec"), dim, kind), stack(b.column("vec"), dim, kind)
            if pivot is None:  # no pivot of this length was drawn: its own first rows serve
                pivot = data[:pivots] / np.linalg.norm(data[:pivots], axis=1)[:, None]
            ids, query_ids = (np.asarray(x.column("id").combine_chunks(), np.int64) for x in (a, b))
            found = search_block(ids, data, query_ids, asked, pivot, min(length, len(pivot)), share, least, k)
        q, v, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    keys = ("dim", "b", "c")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, _SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
