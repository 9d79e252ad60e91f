"""Self-join of documents whose word-shingle sets have a Jaccard similarity of at least 0.8, under several token orders.

1. Each document becomes a class by its set (equal sets are one class).
2. A first filter needs no statistics: under the order of token hashes, two similar sets share so many tokens of their
   prefixes that a class too few of whose prefix tokens occur in any other prefix has no partner.
3. For the classes left, exact document frequencies of all their tokens give three global orders (frequency first, then
   three different hashes). A pair must share a prefix token under every order. So classes that share prefix tokens are
   joined to clusters for each order, and only classes that agree in all three clusters meet.
4. Within a cluster a class is compared with those that share prefix tokens with it under all orders and fit in size; the
   whole sets decide. Comparisons inside a component that is already known are skipped. Large clusters are cut into
   blocks which meet through common members first, and then only where components still differ.

Tokens travel packed in binary columns, dealt out by token hash; numpy does the work of a group. No pairs of a group are
written out: a group gives links that span its components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, columns, discard, join_spread, materialise, mix64, numbered, set_shingles, slices_by_bytes, small_batches, word_hashes
from .components import connected_components

ORDERS = 3
#: Classes of a cluster, and bytes of their sets, that one task compares at once.
BLOCK = 4096
BLOCK_BYTES = 8 << 20
_SALTS = np.array([0x0, 0x517CC1B727220A95, 0x2545F4914F6CDD1D], np.uint64)


def need(n):
    """Least overlap of a set of n tokens with a similar one: ceil(0.8 n)."""
    return (4 * n + 4) // 5


def prefix(n):
    """Tokens of a set of n, first in any global order, among which each similar set has one of its own first."""
    return n - need(n) + 1


def sets_of(texts: pa.Array, shingle: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in ascending order, one text after another, and the texts' starts."""
    data, off = bytes_of(pc.fill_null(texts, ""))
    h, start = set_shingles(*word_hashes(data, off), shingle)
    row = np.repeat(np.arange(len(off) - 1), np.diff(start))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(off)))


def class_of(tokens: np.ndarray) -> int:
    """A 61-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little") >> 3


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions first[i] ... first[i] + size[i] - 1 for all i, one after another."""
    end = np.cumsum(size)
    return np.repeat(first - (end - size), size) + np.arange(end[-1] if len(end) else 0)


def _text_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, tokens, starts, classes) of bounded slices of (id, text) batches; the class of an empty set is -1."""
    for batch in batches:
        for a, b in slices_by_bytes(batch.column(1)):
            part = batch.slice(a, b - a)
            tokens, start = sets_of(part.column(1), shingle)
            classes = np.array([class_of(tokens[x:y]) if y > x else -1 for x, y in zip(start[:-1], start[1:], strict=True)], np.int64)
            yield part, tokens, start, classes


class _Packs:
    """Collects (token, class) postings and gives them out as rows (bucket, tokens, classes, counts), packed."""

    def __init__(self, bits: int, wide: bool, limit: int = 2_000_000) -> None:
        self.bits, self.wide, self.limit, self.held, self.parts = bits, wide, limit, 0, []

    def add(self, tokens: np.ndarray, classes: np.ndarray) -> None:
        self.parts.append((tokens, classes))
        self.held += len(tokens)

    def flush(self, force: bool = False) -> Iterator[pa.RecordBatch]:
        if self.held < (1 if force else self.limit):
            return
        tokens, classes = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.held, self.parts = 0, []
        bucket = (tokens >> np.uint64(64 - self.bits)).astype(np.int64)
        order = np.lexsort((tokens, classes, bucket))
        tokens, classes, bucket = tokens[order], classes[order], bucket[order]
        tokens = tokens if self.wide else ((tokens >> np.uint64(32 - self.bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        rows = []
        for x, y in zip(cut, np.append(cut[1:], len(bucket)), strict=True):
            own = classes[x:y]
            at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            count = np.diff(np.append(at, len(own))).astype(np.int32)
            rows.append((int(bucket[x]), tokens[x:y].tobytes(), own[at].tobytes(), count.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "tokens", "classes", "counts"])


_PACKS = "bucket long, tokens binary, classes binary, counts binary"


def _unpack(group: pa.Table, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (token, class) postings of a bucket, sorted by token, then class."""
    join = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), kind)
    tokens = join("tokens", np.uint64 if wide else np.uint32)
    classes = np.repeat(join("classes", np.int64), join("counts", np.int32))
    order = np.lexsort((classes, tokens))
    tokens, classes = tokens[order], classes[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (classes[1:] != classes[:-1])
    return tokens[new], classes[new]


def _runs(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each posting the start and length of its token's run."""
    at = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    size = np.diff(np.append(at, len(tokens)))
    return np.repeat(at, size), np.repeat(size, size)


def _bits(postings: int, least: int) -> int:
    """Bits of a token hash that number the buckets: about a quarter of a million postings each, so that the few buckets
    which share a task stay small."""
    return max(least, int(postings / 2.5e5).bit_length())


def document_classes(rows: DataFrame, shingle: int) -> DataFrame:
    """(id, row, n, class) of every row (id, text, row): the number of its shingles and the name of its set.

    Null and empty texts, and texts without words, have n 0 and class -1; texts of any length count whole; equal sets
    have one class; repeated rows and null ids are rows of their own; an empty table gives no rows.
    """

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, start, cls in _text_sets(batches, shingle):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.diff(start)), pa.array(cls)], ["id", "row", "n", "class"])

    return rows.select("id", "text", "row").mapInArrow(classes, "id long, row long, n long, class long")


def _survivors(rows: DataFrame, sizes: DataFrame, total: int, shingle: int) -> DataFrame:
    """Classes (class, n) that the hash-order filter leaves; sizes is (class, n).

    With prefixes longer by e = floor(0.2 n) tokens, similar sets share at least 1 + e tokens of the shorter prefix.
    """
    bits = _bits(int(total * 0.4), 8)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = _Packs(bits, wide=False)
        for _, tokens, start, cls in _text_sets(batches, shingle):
            n = np.diff(start)
            take = np.where(n > 0, np.minimum(prefix(n) + n // 5, n), 0)
            packs.add(tokens[_ragged(start[:-1], take)], np.repeat(cls, take))
            yield from packs.flush()
        yield from packs.flush(force=True)

    def shared(group: pa.Table) -> pa.Table:
        tokens, classes = _unpack(group, wide=False)
        _, size = _runs(tokens)
        found, count = np.unique(classes[size > 1], return_counts=True)
        return pa.table({"class": found, "shared": count})

    counts = rows.select("id", "text").mapInArrow(postings, _PACKS).groupBy("bucket").applyInArrow(shared, "class long, shared long").groupBy("class").agg(F.sum("shared").alias("shared"))
    least = F.floor((F.floor((4 * F.col("n") + 4) / 5)) / 5) + 1
    return sizes.join(counts, "class").where(F.col("shared") >= least).select("class", "n")


def _sets(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(class, n, tokens) of the wanted classes. A bit filter of fixed size (1 MB) is broadcast so that few other sets
    leave their task; the join then decides."""
    words = wanted.groupBy((F.col("class") % (1 << 17)).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast((class div 131072) % 64 as int))")).alias("bits")).collect()
    table = np.zeros(1 << 17, np.uint64)
    table[[r.w for r in words]] = [r.bits % (1 << 64) for r in words]
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, seen = shared.value, set()
        for _, tokens, start, cls in _text_sets(batches, shingle):
            safe = np.maximum(cls, 0)
            hit = (cls >= 0) & ((filter_[safe % (1 << 17)] >> ((safe // (1 << 17)) % 64).astype(np.uint64)) & np.uint64(1) == 1)
            out = []
            for i in np.flatnonzero(hit):
                if int(cls[i]) not in seen:
                    seen.add(int(cls[i]))
                    out.append((int(cls[i]), tokens[start[i] : start[i + 1]].tobytes()))
            if len(seen) > 100_000:
                seen.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([t for _, t in out], pa.binary())], ["class", "tokens"])

    return rows.select("id", "text").mapInArrow(pick, "class long, tokens binary").join(wanted, "class").dropDuplicates(["class"])


def _common_tokens(sets: DataFrame, tokens_total: int) -> DataFrame:
    """(class, n, tokens, df): each set's tokens that other sets have too, with their document frequencies."""
    bits = _bits(tokens_total, 6)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = _Packs(bits, wide=True)
        for batch in batches:
            for c, raw in zip(batch.column("class").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                tokens = np.frombuffer(raw, np.uint64)
                packs.add(tokens, np.full(len(tokens), c))
                yield from packs.flush()
        yield from packs.flush(force=True)

    def frequencies(group: pa.Table) -> pa.Table:
        tokens, classes = _unpack(group, wide=True)
        _, size = _runs(tokens)
        keep = size > 1
        order = np.argsort(classes[keep], kind="stable")
        tokens, classes, size = tokens[keep][order], classes[keep][order], size[keep][order].astype(np.int32)
        at = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]])) if len(classes) else np.zeros(0, np.int64)
        ends = np.append(at[1:], len(classes))
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())
        return pa.table({"class": classes[at], "t": cut(tokens), "d": cut(size)})

    parts = sets.select("class", "tokens").mapInArrow(postings, _PACKS).groupBy("bucket").applyInArrow(frequencies, "class long, t binary, d binary")
    whole = parts.groupBy("class").agg(F.collect_list(F.struct("t", "d")).alias("parts"))
    return whole.join(sets.select("class", "n"), "class")


def _ordered(common: DataFrame) -> DataFrame:
    """(class, n, tokens, p0, p1, p2): common tokens in ascending order and the places of the prefix tokens among them
    under each order. Classes whose prefix is taken up by tokens that no other has are gone."""

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for c, n, parts in zip(batch.column("class").to_pylist(), batch.column("n").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                tokens = np.frombuffer(b"".join(p["t"] for p in parts), np.uint64)
                df = np.frombuffer(b"".join(p["d"] for p in parts), np.int32)
                up = np.argsort(tokens)
                tokens, df = tokens[up], df[up]
                take = prefix(n) - (n - len(tokens))
                if take > 0:
                    rows.append((c, n, tokens.tobytes(), *(np.lexsort((mix64(tokens ^ s), df))[:take].astype(np.int32).tobytes() for s in _SALTS)))
            if rows:
                kinds = [pa.int64(), pa.int64(), *[pa.binary()] * (1 + ORDERS)]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["class", "n", "tokens", "p0", "p1", "p2"])

    return common.select("class", "n", "parts").mapInArrow(order, "class long, n long, tokens binary, p0 binary, p1 binary, p2 binary")


def _clusters(ordered: DataFrame, bits: int) -> DataFrame:
    """(class, cluster): classes that are joined by shared prefix tokens under every order; others have no partner."""

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = _Packs(bits + 2, wide=True)
        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("class", "tokens", "p0", "p1", "p2")]
            for c, raw, *places in zip(*columns, strict=True):
                tokens = np.frombuffer(raw, np.uint64)
                for o, p in enumerate(places):  # the order's number lies in the top two bits of the token
                    t = (tokens[np.frombuffer(p, np.int32)] >> np.uint64(2)) | (np.uint64(o) << np.uint64(62))
                    packs.add(t, np.full(len(t), 4 * c + o))
                yield from packs.flush()
        yield from packs.flush(force=True)

    def stars(group: pa.Table) -> pa.Table:
        tokens, nodes = _unpack(group, wide=True)
        first, _ = _runs(tokens)
        a, b = nodes[first], nodes
        pairs = np.unique(np.stack([a[a != b], b[a != b]], 1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    edges = ordered.mapInArrow(postings, _PACKS).groupBy("bucket").applyInArrow(stars, "a long, b long")
    found = connected_components(edges)
    return (
        found.groupBy(F.expr("node div 4").alias("class"))
        .agg(F.count("*").alias("orders"), F.xxhash64(F.array_sort(F.collect_list(F.struct(F.expr("node % 4").alias("o"), "component")))).alias("cluster"))
        .where(f"orders = {ORDERS}")
        .select("class", "cluster")
    )


class _Members:
    """The classes of a block: sizes, tokens and prefix tokens in local numbers."""

    def __init__(self, table: pa.Table) -> None:
        self.names = np.asarray(table.column("class").combine_chunks(), np.int64)
        self.n = np.asarray(table.column("n").combine_chunks(), np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        self.start = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        values, self.tokens = np.unique(np.concatenate(sets), return_inverse=True)
        self.width, m = len(values), len(sets)
        self.postings, self.own = [], []
        for o in range(ORDERS):
            places = [np.frombuffer(x, np.int32) for x in table.column(f"p{o}").to_pylist()]
            own = [self.tokens[self.start[i] + p] for i, p in enumerate(places)]
            doc = np.repeat(np.arange(m), [len(p) for p in own])
            flat = np.concatenate(own)
            order = np.argsort(flat, kind="stable")
            self.own.append(own)
            self.postings.append((doc[order], np.searchsorted(flat[order], np.arange(self.width + 1))))

    def similar(self, i: int, among: np.ndarray) -> np.ndarray:
        """Members among (a mask) that link with i: they share prefix tokens under all orders, and the sets decide."""
        left = among & (5 * np.minimum(self.n, self.n[i]) >= 4 * np.maximum(self.n, self.n[i]))
        left[i] = False
        for own, (doc, at) in zip(self.own, self.postings, strict=True):
            mine = own[i]
            met = np.zeros(len(left), bool)
            met[doc[_ragged(at[mine], at[mine + 1] - at[mine])]] = True
            left &= met
        found = np.flatnonzero(left)
        if not len(found):
            return found
        mark = np.zeros(self.width, np.int64)
        mark[self.tokens[self.start[i] : self.start[i + 1]]] = 1
        size = self.start[found + 1] - self.start[found]
        hits = np.add.reduceat(mark[self.tokens[_ragged(self.start[found], size)]], np.cumsum(size) - size)
        return found[100 * hits >= 80 * (self.n[i] + self.n[found] - hits)]


def _spanning(members: _Members) -> list[tuple[int, int]]:
    """Links that span the components of a block: a search that compares each member with those not yet reached."""
    links, left = [], np.ones(len(members.names), bool)
    for seed in range(len(left)):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            i = queue.pop()
            for j in members.similar(i, left):
                left[j] = False
                links.append((members.names[i], members.names[j]))
                queue.append(int(j))
    return links


def _as_links(links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _parts(table: pa.Table, by: str) -> Iterator[pa.Table]:
    """The table's rows of each value of a column."""
    table = table.sort_by(by)
    values = np.asarray(table.column(by).combine_chunks(), np.int64)
    cut = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else []
    for a, b in zip(cut, np.append(cut[1:], len(values)) if len(cut) else [], strict=True):
        yield table.slice(a, b - a)


def _links(ordered: DataFrame, clusters: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Spanning links (a, b) of all clusters, and the written tables that they are read from."""
    spark = ordered.sparkSession
    weight = F.octet_length("tokens") + sum((F.octet_length(f"p{o}") for o in range(1, ORDERS)), F.octet_length("p0")) + 64
    sized = clusters.join(ordered.select("class", weight.alias("bytes")), "class").groupBy("cluster").agg(F.count("*").alias("m"), F.sum("bytes").alias("bytes")).where("m > 1")
    sized = materialise(sized, "clusters-sized")
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    # Clusters of less than a block share groups of about a block's bytes; the wanted number grows with the table.
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_BYTES))
    blocks = F.expr(f"cast(ceil(greatest(m / {BLOCK}, bytes / {BLOCK_BYTES})) as int)")
    placed = (
        clusters.join(sized, "cluster")
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
        # Some members of a large cluster stand in all of its blocks, so that the blocks meet through them.
        .withColumn("common", (F.col("blocks") > 1) & (F.pmod(F.xxhash64("class", F.lit(1)), F.expr(f"cast(ceil(greatest(m / 64, 64 * bytes / {BLOCK_BYTES})) as int)")) == 0))
        .drop("bytes")
    )
    placed = materialise(placed.join(ordered, "class"), "placed")
    group = F.when(F.col("blocks") > 1, F.col("cluster")).otherwise(F.pmod("cluster", F.lit(groups)))
    where_ = F.when(F.col("common"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    first = placed.withColumn("g", group).withColumn("at", F.explode(where_)).select("g", "at", "cluster", "class", "n", "tokens", "p0", "p1", "p2")

    def span(table: pa.Table) -> pa.Table:
        return _as_links([x for part in _parts(table, "cluster") for x in _spanning(_Members(part))])

    links = materialise(first.groupBy("g", "at").applyInArrow(span, "a long, b long"), "links")
    large = placed.where("blocks > 1")
    if large.isEmpty():
        discard(placed)
        return links, [sized, links]
    # Blocks of a large cluster that still lie in several components: members outside its largest visit those blocks
    # with whose members they share prefix tokens.
    second = _visits(large, connected_components(links))

    def meet(table: pa.Table) -> pa.Table:
        guest = np.asarray(table.column("guest").combine_chunks())
        outside = np.asarray(table.column("outside").combine_chunks())
        part = np.asarray(table.column("part").combine_chunks(), np.int64)
        members = _Members(table)
        links, known = [], set()
        for i in np.flatnonzero(guest):
            # Two members outside the largest component visit each other's block; one of the visits compares them.
            for j in members.similar(int(i), ~guest & (part != part[i]) & (~outside | (members.names > members.names[i]))):
                if (part[i], part[j]) not in known:
                    known.add((part[i], part[j]))
                    links.append((members.names[i], members.names[j]))
        return _as_links(links)

    more = materialise(second.groupBy("cluster", "at", "chunk").applyInArrow(meet, "a long, b long"), "links")
    discard(placed)
    return links.unionByName(more), [sized, links, more]


def _shared_blocks(now: DataFrame) -> DataFrame:
    """(cluster, class, to): for members outside their cluster's largest component, the other blocks where under every
    order some member holds one of their prefix tokens."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns_ = [batch.column(x).to_pylist() for x in ("cluster", "class", "block", "outside", "tokens", "p0", "p1", "p2")]
            for cluster, c, block, outside, raw, *places in zip(*columns_, strict=True):
                tokens = np.frombuffer(raw, np.uint64).view(np.int64)
                own = [tokens[np.frombuffer(p, np.int32)] for p in places]
                n, size = sum(map(len, own)), [len(x) for x in own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, cluster)), pa.array(np.full(n, c)), pa.array(np.full(n, block, np.int32)), pa.array(np.full(n, outside)), pa.array(np.repeat(np.arange(ORDERS, dtype=np.int32), size)), pa.array(np.concatenate(own))],
                    ["cluster", "class", "block", "outside", "o", "token"],
                )

    schema = "cluster long, class long, block int, outside boolean, o int, token long"
    held = materialise(now.select("cluster", "class", "block", "outside", "tokens", "p0", "p1", "p2").mapInArrow(prefixes, schema), "prefixes")
    homes = held.select("cluster", "o", "token", F.col("block").alias("to")).distinct()
    met = held.where("outside").join(homes, ["cluster", "o", "token"]).where("to <> block").select("cluster", "class", "o", "to").distinct()
    return met.groupBy("cluster", "class", "to").agg(F.count("*").alias("orders")).where(f"orders = {ORDERS}").select("cluster", "class", "to")


def _visits(large: DataFrame, parts: DataFrame) -> DataFrame:
    """Members of clusters cut into blocks that lie in several components, dealt to groups (cluster, at, chunk): the
    members of block `at`, and as guests a chunk of about a block's size of those outside the cluster's largest component
    who live in other blocks and share prefix tokens with this one under every order. Members of one block have met
    before."""
    now = large.join(parts.select(F.col("node").alias("class"), F.col("component").alias("part")), "class", "left").withColumn("part", F.coalesce("part", "class"))
    sizes = now.groupBy("cluster", "part").agg(F.count("*").alias("size"))
    main = sizes.groupBy("cluster").agg(F.max_by("part", F.struct("size", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    now = now.join(main.select("cluster", "main"), "cluster").withColumn("outside", F.col("part") != F.col("main"))
    now = materialise(now.select("cluster", "class", "n", "tokens", "p0", "p1", "p2", "block", "blocks", "part", "outside"), "blocks")
    met = materialise(_shared_blocks(now), "visits")
    # As many chunks of guests for a block as its visitors fill; its members meet each chunk.
    chunks = now.groupBy("cluster").agg((F.first("blocks")).alias("b"), F.count("*").alias("m"))
    room = F.expr("greatest(1, cast(ceil(m / b) as int))")
    visitors = met.groupBy("cluster", F.col("to").alias("at")).agg(F.count("*").alias("v")).join(chunks.select("cluster", room.alias("room")), "cluster").select("cluster", "at", F.expr("cast(ceil(v / room) as int)").alias("chunks"))
    columns_ = ["cluster", "at", "chunk", "class", "n", "tokens", "p0", "p1", "p2", "part", "outside", "guest"]
    home = now.withColumn("at", F.col("block")).join(visitors, ["cluster", "at"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("guest", F.lit(False))
    away = met.withColumnRenamed("to", "at").join(visitors, ["cluster", "at"]).withColumn("chunk", F.pmod(F.xxhash64("class", F.lit(2)), "chunks").cast("int")).join(now, ["cluster", "class"]).withColumn("guest", F.lit(True))
    return home.select(*columns_).unionByName(away.select(*columns_))


def _components(rows: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(id, row, n, class) of every row (id, text, row), and (class, least, m, component) of every class of rows with
    words, written."""
    small_batches(rows.sparkSession)
    known = materialise(document_classes(rows, shingle), "classes")
    classes = materialise(known.where("class >= 0").groupBy("class").agg(F.first("n").alias("n"), F.min("id").alias("least"), F.count("*").alias("m")), "sizes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    wanted = materialise(_survivors(rows, classes.select("class", "n"), total, shingle), "wanted")
    sets = materialise(_sets(rows, wanted, shingle), "sets")
    tokens = sets.agg(F.sum("n")).first()[0] or 0
    ordered = materialise(_ordered(_common_tokens(sets, tokens)), "ordered")
    clusters = materialise(_clusters(ordered, _bits(tokens, 6)), "clusters")
    links, used = _links(ordered, clusters)
    parts = connected_components(links)
    rooted = materialise(classes.join(parts.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class")), "rooted")
    discard(classes, wanted, sets, ordered, clusters, *used)
    return known, rooted


def similar_documents(docs: DataFrame, shingle: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set holds the distinct shingles of so many
    words (the whole sequence where there are fewer words), each known by a 64-bit hash. Two documents link where
    100 * intersection >= 80 * union. A null or empty text has an empty set and links with nothing; texts of any length
    count whole. Rows of equal or null keys are documents of their own. An empty table gives no rows; other columns,
    whatever their names, play no part.
    """
    rows = columns(docs, id=key, text=text).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    known, rooted = _components(rows, shingle)
    least = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialise(rooted.join(least, "component").select("class", "m", "component_id"), "components")
    found = join_spread(known, named, "class", "m", "component_id")
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def drop_similar(docs: DataFrame, shingle: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group that similar_documents links: the one of smallest key (null keys last), then the
    first. Rows of equal or null keys are documents of their own; rows without words stay. All columns stay as they are,
    whatever their names. An empty table gives no rows."""
    held, names = numbered(docs)
    doc, body = names[docs.columns.index(key)], names[docs.columns.index(text)]
    known, rooted = _components(held.select(F.col(doc).cast("long").alias("id"), F.col(body).cast("string").alias("text"), "row"), shingle)
    firsts = known.where("class >= 0").groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    each = rooted.join(firsts, "class")
    kept = each.groupBy("component").agg(F.min("first").alias("first"))
    named = materialise(each.select("class", "m", "component").join(kept, "component").select("class", "m", F.col("first.row").alias("keep")), "kept")
    gone = join_spread(known, named, "class", "m", "keep").where("keep <> row").select("row")
    return held.join(gone, "row", "left_anti").select(*(F.col(c).alias(old) for c, old in zip(names, docs.columns)))
