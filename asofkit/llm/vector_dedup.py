"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_spread, materialise
from .components import connected_components
from .vectors import packed_vectors, stack, vector_kind

#: Vectors of a bucket that one task compares; larger buckets are cut into blocks that meet in pairs.
BLOCK = 4096
_SCHEMA = "class long, links long, root long"


def table_plan(n: int, similarity: float, recall: float, bucket: int = 256) -> tuple[int, int]:
    """Bits of a code, so that buckets hold about `bucket` of n vectors, and the tables by which a pair at exactly the
    threshold meets with the wanted probability (closer pairs meet more surely)."""
    bits = min(24, max(4, round(math.log2(max(n, 1) / bucket)) if n > bucket else 4))
    meet = (1 - math.acos(similarity) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def sign_codes(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Codes of each vector in each table, from hyperplanes that depend on the length and the table alone."""
    planes = np.random.Generator(np.random.PCG64(7 + unit.shape[1])).standard_normal((tables * bits, unit.shape[1]))
    sign = (unit @ planes.T > 0).reshape(len(unit), tables, bits)
    return (sign * (1 << np.arange(bits))).sum(2).astype(np.int32)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return up
        parent = up


def compare(a: dict, b: dict | None, table: int, similarity: float) -> list[tuple[int, int, int]]:
    """(class, links, root) of the vectors of a block, or of two blocks of a bucket, that link.

    links adds up the rows of the classes that a class links with; a pair is counted in the first table where its codes
    agree. roots span the components.
    """
    both = a if b is None else {k: np.concatenate([a[k], b[k]]) for k in a}
    n, split = len(both["class"]), None if b is None else len(a["class"])
    norm = np.linalg.norm(both["vec"], axis=1)
    parent, links = np.arange(n), np.zeros(n, np.int64)
    columns = np.arange(n) if split is None else np.arange(split, n)
    for r in range(0, n if split is None else split, 512):
        rows = np.arange(r, min(r + 512, n if split is None else split))
        cosine = (both["vec"][rows] @ both["vec"][columns].T) / (norm[rows][:, None] * norm[columns][None, :])
        i, j = np.nonzero(cosine >= similarity)
        i, j = rows[i], columns[j]
        i, j = (i[i < j], j[i < j]) if split is None else (i, j)
        new = np.ones(len(i), bool)
        for t in range(table):
            new &= both["codes"][i, t] != both["codes"][j, t]
        i, j = i[new], j[new]
        np.add.at(links, i, both["m"][j])
        np.add.at(links, j, both["m"][i])
        while len(i):  # hook the larger root of each pair under the smaller
            parent = _roots(parent)
            x, y = parent[i], parent[j]
            open_ = x != y
            if not open_.any():
                break
            i, j, x, y = i[open_], j[open_], x[open_], y[open_]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
    parent = _roots(parent)
    keep = np.flatnonzero(links)
    return list(zip(both["class"][keep].tolist(), links[keep].tolist(), both["class"][parent[keep]].tolist(), strict=True))


def close_codes(bits: np.ndarray, codes: np.ndarray, columns: np.ndarray, split: int, table: int, most: float, limit: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs (i < split, j in columns, i < j) of a bucket whose codes differ in at most `most` bits and that share no code
    in an earlier table; None if there are more than limit."""
    sign = bits.astype(np.float32) * 2 - 1
    found_i, found_j, held = [], [], 0
    for r in range(0, split, 512):
        rows = np.arange(r, min(r + 512, split))
        far = (bits.shape[1] - sign[rows] @ sign[columns].T) / 2
        i, j = np.nonzero(far <= most)
        i, j = rows[i], columns[j]
        i, j = i[i < j], j[i < j]
        for a in range(0, len(i), 1 << 16):
            x, y = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
            new = ~(codes[x, :table] == codes[y, :table]).any(1)
            found_i.append(x[new])
            found_j.append(y[new])
            held += int(new.sum())
            if held > limit:
                return None
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


def near_duplicates(rows: DataFrame, similarity: float = 0.9, recall: float = 0.999, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable by
    links, itself included), kept (vec_id = component_id).

    Two vectors link if their cosine, in double precision, is at least the similarity; a pair at exactly the threshold
    is found with the probability `recall`, closer pairs more surely, equal vectors always. Equal vectors are one class
    and compared once. Vectors that are null, empty, zero or hold null or non-finite components, or differ in length,
    link with nothing. Rows of equal or null ids are vectors of their own; other columns play no part. An empty table
    gives no rows.

    Buckets hold codes, not vectors. Pairs of a bucket whose codes in all tables differ in few enough bits (four standard
    deviations beyond what the threshold gives, which misses 1 in 30,000 pairs at the threshold) fetch their vectors.
    In a bucket with more than 16 such pairs a member, which is a group of near copies, the vectors themselves meet, so
    that no list of all pairs of a group is made. Either way the exact cosine decides.
    """
    kind = vector_kind(rows, embedding)
    vectors = packed_vectors(rows, key, embedding)
    known = materialise(vectors.select("id", F.when(F.col("vec").isNotNull(), F.xxhash64("vec", F.lit(3))).alias("class"), "vec", "dim"), "vectors")
    classes = materialise(known.where("class is not null").groupBy("class").agg(F.min("id").alias("least"), F.count("*").alias("m"), F.first("vec").alias("vec"), F.first("dim").alias("dim")), "classes")
    bits, tables = table_plan(classes.count(), similarity, recall)
    far = math.acos(similarity) / math.pi
    most = bits * tables * far + 4 * math.sqrt(bits * tables * far * (1 - far))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for dim in set(table.column("dim").to_pylist()):
                part = table.filter(pa.compute.equal(table.column("dim"), dim))
                unit = stack(part.column("vec"), dim, kind)
                codes = sign_codes(unit / np.linalg.norm(unit, axis=1)[:, None], bits, tables)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables), pa.int32()), pa.array(codes.ravel()))
                yield from pa.table([part.column("class"), part.column("m"), part.column("dim"), lists], names=["class", "m", "dim", "codes"]).combine_chunks().to_batches()

    coded = materialise(classes.select("class", "m", "dim", "vec").mapInArrow(code, "class long, m long, dim int, codes array<int>"), "codes")
    each = coded.select("class", "m", "dim", "codes", F.posexplode("codes").alias("t", "code"))
    sizes = each.groupBy("dim", "t", "code").agg(F.count("*").alias("n"))
    large = materialise(sizes.where(F.col("n") > BLOCK).withColumn("blocks", F.expr(f"cast(ceil(n / {BLOCK}) as int)")).drop("n"), "buckets")
    placed = each.join(large, ["dim", "t", "code"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    # A block meets itself and every other one: as the first of a pair with later ones, as the second with earlier ones.
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).drop("other", "blocks")
    keys = ["dim", "t", "code", "x", "y"]

    def sides(group: pa.Table) -> tuple[pa.Table, int, np.ndarray]:
        """The group's first block before its second, the size of the first, and the places that it meets."""
        first = np.asarray(pa.compute.equal(group.column("block"), group.column("x")))
        group, n = group.take(pa.array(np.argsort(~first, kind="stable"))), int(first.sum())
        alone = group.num_rows == 0 or group.column("x")[0].as_py() == group.column("y")[0].as_py()
        return group, n, np.arange(0 if alone else n, group.num_rows)

    def codes_of(group: pa.Table) -> np.ndarray:
        return np.asarray(group.column("codes").combine_chunks().flatten()).reshape(group.num_rows, tables)

    def candidates(group: pa.Table) -> pa.Table:
        group, n, columns = sides(group)
        codes, table = codes_of(group), group.column("t")[0].as_py()
        split_bits = ((codes[:, :, None] >> np.arange(bits)) & 1).reshape(len(codes), -1)
        found = close_codes(split_bits, codes, columns, n, table, most, 16 * group.num_rows)
        names, m, k = np.asarray(group.column("class").combine_chunks(), np.int64), np.asarray(group.column("m").combine_chunks(), np.int64), [group.column(c)[0].as_py() for c in keys]
        i, j = found if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        out = pa.table({"a": names[i], "b": names[j], "ma": m[i], "mb": m[j], "dense": pa.array(np.zeros(len(i), bool))})
        if found is None:
            out = pa.table({"a": pa.array([None], pa.int64()), "b": pa.array([None], pa.int64()), "ma": pa.array([0]), "mb": pa.array([0]), "dense": pa.array([True])})
        for c, v, t in zip(keys, k, (pa.int32(),) * 5, strict=True):
            out = out.append_column(c, pa.array([v] * out.num_rows, t))
        return out

    schema = "a long, b long, ma long, mb long, dense boolean, dim int, t int, code int, x int, y int"
    met = materialise(pairs.groupBy(*keys).applyInArrow(candidates, schema), "candidates")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for dim in set(table.column("dim").to_pylist()):
                part = table.filter(pa.compute.equal(table.column("dim"), dim))
                u, v = stack(part.column("u"), dim, kind), stack(part.column("v"), dim, kind)
                near = (u * v).sum(1) / (np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1)) >= similarity
                yield from part.select(["a", "b", "ma", "mb"]).filter(pa.array(near)).combine_chunks().to_batches()

    vector = classes.select("class", "vec")
    fetched = met.where("not dense").select("a", "b", "ma", "mb", "dim").join(vector.select(F.col("class").alias("a"), F.col("vec").alias("u")), "a").join(vector.select(F.col("class").alias("b"), F.col("vec").alias("v")), "b")
    linked = materialise(fetched.select("a", "b", "ma", "mb", "dim", "u", "v").mapInArrow(verify, "a long, b long, ma long, mb long"), "linked")

    def meet(group: pa.Table) -> pa.Table:
        group, n, columns = sides(group)
        dim, table, codes = group.column("dim")[0].as_py(), group.column("t")[0].as_py(), codes_of(group)
        part = lambda a, b: {"class": np.asarray(group.column("class").combine_chunks(), np.int64)[a:b], "m": np.asarray(group.column("m").combine_chunks(), np.int64)[a:b], "vec": stack(group.column("vec").slice(a, b - a), dim, kind), "codes": codes[a:b]}
        total = group.num_rows
        if n == total:
            found = compare(part(0, total), None, table, similarity) if len(columns) else []
        else:
            found = compare(part(0, n), part(n, total), table, similarity) if n else []
        c, n_, r = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"class": pa.array(c, pa.int64()), "links": pa.array(n_, pa.int64()), "root": pa.array(r, pa.int64())})

    crowded = pairs.join(met.where("dense").select(*keys), keys).join(vector, "class")
    dense = materialise(crowded.groupBy(*keys).applyInArrow(meet, _SCHEMA), "links")
    parts = connected_components(linked.select("a", "b").unionByName(dense.select(F.col("class").alias("a"), F.col("root").alias("b"))))
    single = linked.select(F.col("a").alias("class"), F.col("mb").alias("links")).unionByName(linked.select(F.col("b").alias("class"), F.col("ma").alias("links")))
    degrees = single.unionByName(dense.select("class", "links")).groupBy("class").agg(F.sum("links").alias("links"))
    rooted = classes.select("class", "least", "m").join(parts.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "component").join(degrees, "class", "left").select("class", "m", F.struct((F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id").alias("found"))
    named = materialise(named, "components")
    discard(classes, coded, large, met, linked, dense)
    out = join_spread(known.select("id", "class"), named, "class", "m", "found")
    component = F.coalesce(F.col("found.component_id"), F.col("id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce(F.col("found.n_links"), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
