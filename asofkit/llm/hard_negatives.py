"""Hard negatives by inner product of quantised vectors, with angular triangle filtering.

Every row stores its norm and its angles to a few reference directions. The angles of an anchor and a row enclose the
angle between them from both sides (|s - t| below, s + t above), so their cosine lies in an interval and their score in
that interval times both norms. Only pairs whose interval can still matter are scored, with integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, discard, materialise, small_batches
from .vectors import stack

#: Slack of a cosine bound: angles are taken by half-angle tangents, whose error stays far below this.
SLACK = 1e-9
_INT, _LONG = 2**53, 2**63 - 1
_KIND = "<f8"  # whole numbers as doubles: floor(scale * x) is one, whatever its size


def quantised(rows: DataFrame, scale: int, key: str, embedding: str, label: str) -> DataFrame:
    """(id, label, dim, vec): floor(scale * x) of each component; of rows that share an id, the least by label and bytes."""
    small_batches(rows.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, dims = [], []
            for v in batch.column(2):
                x = None
                if v.is_valid and v.values.null_count == 0:
                    with np.errstate(over="ignore", invalid="ignore"):
                        x = np.floor(np.asarray(v.values, np.float64) * scale)
                ok = x is not None and bool((np.abs(x) < 2**62).all())  # false for what is not finite
                vectors.append((x + 0.0).astype(_KIND).tobytes() if ok else None)  # + 0.0: no negative zero
                dims.append(len(x) if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(vectors, pa.binary())], ["id", "label", "dim", "vec"])

    given = columns(rows, id=key, label=label, e=embedding).where("id is not null and label is not null")
    packed = given.select(F.col("id").cast("long"), F.col("label").cast("long"), "e").mapInArrow(pack, "id long, label long, dim int, vec binary").where("vec is not null")
    return packed.groupBy("id").agg(F.min(F.struct("label", "dim", "vec")).alias("r")).select("id", "r.label", "r.dim", "r.vec")


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at length 1 (zero rows stay zero) and their norms."""
    norm = np.linalg.norm(x, axis=1)
    return x / np.where(norm > 0, norm, 1)[:, None], norm


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n directions among rows, each the one whose nearest direction so far is farthest."""
    u = unit(x)[0]
    u = u[(u != 0).any(1)]
    picked, nearest = [], np.full(len(u), -2.0)
    for _ in range(min(n, len(u))):
        at = int(nearest.argmin())
        if nearest[at] > 1 - 1e-6:
            break
        picked.append(at)
        nearest = np.maximum(nearest, u @ u[at])
    return u[picked]


def angles_to(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles of rows to directions, as 2 atan(|u - v| / |u + v|), which is exact to a few units in the last place."""
    u = unit(x)[0]
    out = np.empty((len(u), len(directions)))
    for r, d in enumerate(directions):
        out[:, r] = 2 * np.arctan2(np.linalg.norm(u - d, axis=1), np.linalg.norm(u + d, axis=1))
    return out


def score_bounds(a: tuple[np.ndarray, np.ndarray], x: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Below and above each pair's score, from (angles, norms) of anchors and rows."""
    low, high = np.full((len(a[1]), len(x[1])), -1.0), np.full((len(a[1]), len(x[1])), 1.0)
    for r in range(a[0].shape[1]):
        same = np.multiply.outer(np.cos(a[0][:, r]), np.cos(x[0][:, r]))
        across = np.multiply.outer(np.sin(a[0][:, r]), np.sin(x[0][:, r]))
        np.maximum(low, same - across, out=low)  # cos(s + t)
        np.minimum(high, same + across, out=high)  # cos(s - t)
    norms = np.multiply.outer(a[1], x[1])
    low, high = np.floor((low - SLACK) * norms) - 1, np.ceil((high + SLACK) * norms) + 1
    end = 2.0**63  # where scores end
    return np.clip(low, -end, end - 1024), np.clip(high, 1024 - end, end)


def exact_scores(a: np.ndarray, x: np.ndarray, asked: np.ndarray, largest: float) -> np.ndarray:
    """Integer inner products of the asked pairs, others unset: doubles where no sum can leave their whole numbers
    (largest bounds the product of norms), else Python's integers, ended at those of 64 bits."""
    out = np.zeros(asked.shape, np.int64)
    cols = np.flatnonzero(asked.any(0))
    if largest < _INT:
        out[:, cols] = (a @ x[cols].T).astype(np.int64)
        return out
    for i, j in zip(*np.nonzero(asked)):
        out[i, j] = min(max(sum(int(p) * int(q) for p, q in zip(a[i], x[j])), -_LONG), _LONG)
    return out


class Block:
    """Rows of one block with what bounds need."""

    def __init__(self, t: pa.Table, dim: int) -> None:
        self.ids, self.labels = (np.asarray(t.column(c).combine_chunks(), np.int64) for c in ("id", "label"))
        self.x = stack(t.column("vec"), dim, _KIND) if dim else np.zeros((len(self.ids), 0))
        self.norm = np.asarray(t.column("norm").combine_chunks(), np.float64)
        joined = b"".join(t.column("angles").to_pylist())
        self.angles = np.frombuffer(joined, _KIND).reshape(len(self.ids), -1) if joined else np.zeros((len(self.ids), 0))

    def chunks(self, others: int, cells: int = 1 << 20) -> Iterator[np.ndarray]:
        step = max(1, cells // max(others, 1))
        for k in range(0, len(self.ids), step):
            yield np.arange(k, min(k + step, len(self.ids)))


def _nth_largest(values: np.ndarray, n: int) -> np.ndarray:
    """Each row's n-th largest value; -inf if it has fewer."""
    return np.partition(values, -n, axis=1)[:, -n] if values.shape[1] >= n else np.full(len(values), -np.inf)


def best_positives(anchors: Block, rows: Block, k: int) -> list[tuple[int, int, int]]:
    """(anchor, row, score) of the k best other rows of each anchor's label within the block."""
    found = []
    order = np.argsort(rows.labels, kind="stable")
    for label in np.unique(anchors.labels).tolist():
        mine = order[np.searchsorted(rows.labels, label, "left", order) : np.searchsorted(rows.labels, label, "right", order)]
        asking = np.flatnonzero(anchors.labels == label)
        for c in anchors.chunks(len(mine)):
            at = asking[c[c < len(asking)]]
            if not len(at) or not len(mine):
                continue
            low, high = score_bounds((anchors.angles[at], anchors.norm[at]), (rows.angles[mine], rows.norm[mine]))
            other = rows.ids[mine][None, :] != anchors.ids[at][:, None]
            asked = other & (high >= _nth_largest(np.where(other, low, -np.inf), k)[:, None])
            score = exact_scores(anchors.x[at], rows.x[mine], asked, anchors.norm[at].max() * rows.norm[mine].max())
            for i, a in enumerate(at.tolist()):
                js = np.flatnonzero(asked[i])
                js = js[np.lexsort((rows.ids[mine[js]], -score[i, js]))][:k]
                found += [(int(anchors.ids[a]), int(rows.ids[mine[j]]), int(score[i, j])) for j in js]
    return found


def best_negatives(anchors: Block, windows: list[list[tuple[int, int]]], rows: Block, k: int, least: float, most: float) -> list[tuple[int, int, int, int, int]]:
    """(anchor, positive, its score, row, score) of the k best rows of other labels in each window within the block.

    windows[i] holds the (positive, score) of anchor i; a row is in the window if least * score <= 100 * its own score <=
    most * score.
    """
    found = []
    for at in anchors.chunks(len(rows.ids)):
        low, high = score_bounds((anchors.angles[at], anchors.norm[at]), (rows.angles, rows.norm))
        other = rows.labels[None, :] != anchors.labels[at][:, None]
        asked = np.zeros(other.shape, bool)
        spans = []
        for i, a in enumerate(at.tolist()):
            for p, s in windows[a]:
                first, last = -(-least * s // 100), most * s // 100
                if first > last:
                    continue
                spans.append((i, p, s, first, last))
                inside = other[i] & (high[i] >= first) & (low[i] <= last)
                sure = low[i, inside & (low[i] >= first) & (high[i] <= last)]
                if len(sure) >= k:  # rows that k rows of this window beat for certain are out
                    inside &= high[i] >= np.partition(sure, -k)[-k]
                asked[i] |= inside
        if not asked.any():
            continue
        score = exact_scores(anchors.x[at], rows.x, asked, anchors.norm[at].max() * rows.norm.max())
        for i, p, s, first, last in spans:
            js = np.flatnonzero(asked[i] & (score[i] >= first) & (score[i] <= last))
            js = js[np.lexsort((rows.ids[js], -score[i, js]))][:k]
            found += [(int(anchors.ids[at[i]]), p, s, int(rows.ids[j]), int(score[i, j])) for j in js]
    return found


def mine_hard_negatives(
    rows: DataFrame,
    is_anchor: str,
    positives: int = 5,
    negatives: int = 3,
    least: int = 50,
    most: int = 95,
    scale: int = 256,
    references: int = 12,
    sample: int = 1024,
    block: int = 8192,
    anchor_block: int = 2048,
    key: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    is_anchor is a predicate over id. An anchor's positives are its best other rows of the same label; for each, the best
    rows of other labels with least * positive_score <= 100 * negative_score <= most * positive_score. Scores are integer
    inner products of floor(scale * x); ties go to the smaller id. The reference directions are far-apart rows of a
    sample of fixed size; they change what is pruned, never the result. Blocks of rows meet blocks of anchors, so no
    label, however common, gathers anywhere.

    Rows with a null id, label, vector or component, with a component that is not finite or not a 64-bit integer once
    scaled take no part. Zero and empty vectors do, scoring 0; vectors of different lengths don't meet. Of rows that
    share an id the least by label and vector counts, so repeated rows count once. Scores beyond 64 bits end there. An
    empty table, and an anchor without positives, give no rows; other columns play no part.
    """
    spark = rows.sparkSession
    plain = materialise(quantised(rows, scale, key, embedding, label), "quantised")
    n, m = plain.count(), plain.where(is_anchor).count()
    drawn: dict[int, list[np.ndarray]] = {}
    for r in plain.orderBy(F.xxhash64("id"), "id").limit(sample).collect():
        drawn.setdefault(r.dim, []).append(np.frombuffer(bytes(r.vec), _KIND))
    directions = spark.sparkContext.broadcast({d: far_apart(np.stack(v), references) for d, v in drawn.items() if d})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms, angles = [], []
            for d, v in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, to = np.frombuffer(v, _KIND).reshape(1, -1), directions.value.get(d)
                norms.append(float(np.linalg.norm(x)))
                angles.append(b"" if to is None else angles_to(x, to).astype(_KIND).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norms, pa.float64()), pa.array(angles, pa.binary())], [*batch.schema.names, "norm", "angles"])

    table = materialise(plain.mapInArrow(measure, "id long, label long, dim int, vec binary, norm double, angles binary"), "angles")
    discard(plain)
    blocks, asking = max(1, -(-n // block)), max(1, -(-m // anchor_block))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    of = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    left = table.select("*", of(blocks).alias("b"), every(asking).alias("c"))
    anchors = table.where(is_anchor)
    right = lambda t: t.select("*", every(blocks).alias("b"), of(asking).alias("c"))
    keys = ("dim", "b", "c")

    def positive(at: tuple, x: pa.Table, a: pa.Table) -> pa.Table:
        dim = at[0].as_py()
        found = best_positives(Block(a, dim), Block(x, dim), positives) if x.num_rows and a.num_rows else []
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ((),) * 3)], ["anchor_id", "positive_id", "positive_score"])

    pairs = left.groupBy(*keys).cogroup(right(anchors).groupBy(*keys)).applyInArrow(positive, "anchor_id long, positive_id long, positive_score long")
    nth = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    chosen = pairs.withColumn("nth", nth).where(F.col("nth") <= positives)
    windows = chosen.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("windows"))
    armed = materialise(anchors.join(windows, F.col("id") == F.col("anchor_id")).drop("anchor_id"), "anchors")

    def negative(at: tuple, x: pa.Table, a: pa.Table) -> pa.Table:
        dim, found = at[0].as_py(), []
        if x.num_rows and a.num_rows:
            spans = [[(w["positive_id"], w["positive_score"]) for w in ws] for ws in a.column("windows").to_pylist()]
            found = best_negatives(Block(a, dim), spans, Block(x, dim), negatives, least, most)
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ((),) * 5)], names)

    mined = left.groupBy(*keys).cogroup(right(armed).groupBy(*keys)).applyInArrow(negative, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return mined.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
