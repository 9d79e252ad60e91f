"""Language-model scores by prediction by partial matching over bytes.

A text counts as its lower-cased words, each followed by a space, and one end byte; contexts before its start are end
bytes. All training texts are counted into a trie of byte contexts up to a fixed order. A byte is coded in its longest
known context, escaping (method D) to shorter ones; symbols of a longer context are excluded from the shorter. Symbols
seen in a context are also seen in each shorter one, so a node needs four numbers only: its count, its symbols, and both
for its parent without them. The code length of a text is the sum over its bytes.

Nothing of the trie is held whole. Texts lie in pieces of bounded size, one row each; a piece names its distinct grams
(context and byte) and words, their counts are summed by hash, the trie is built in subtries that share their contexts'
last two bytes, and every piece gets the values of its own grams and words back, in the order in which it named them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, _SPACE, bytes_of, columns, materialise, mix64, n_partitions, small_batches, word_hashes

END, GAP = 0x0A, 0x20
#: Byte values that occur: all but the white space that never stands in a word, the end and the gap aside.
SYMBOLS = 252
PIECE_BYTES = 16 << 20
SEGMENT = 1 << 20
#: Packed grams and words that one task sums up.
BUCKET_BYTES = 32 << 20
_LEARN = np.uint64(1 << 8)


def canonical(data: np.ndarray, off: np.ndarray) -> list[tuple[bytes, int]]:
    """Each row's words, lower-cased and followed by a gap, with the end byte, and how many words there are."""
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        parts, words, open_ = [], 0, False
        for k in range(a, b, SEGMENT):
            x = data[k : min(k + SEGMENT, b)]
            space = _SPACE[x]
            before = np.concatenate([[not open_], space[:-1]])
            closes = space & ~before  # the first white space after a word
            words += int((~space & before).sum())
            y = np.where(space, np.uint8(GAP), _LOWER[x])
            parts.append(y[~space | closes].tobytes())
            open_ = not space[-1]
        out.append((b"".join([*parts, b" " if open_ else b"", b"\n"]), words))
    return out


class Texts:
    """The streams of a piece, each behind `order` end bytes, to be read in segments."""

    def __init__(self, streams: bytes, lengths: list[int], order: int) -> None:
        data = np.frombuffer(pa.decompress(streams, decompressed_size=sum(lengths), codec="zstd", asbytes=True), np.uint8)
        self.order, size = order, np.array(lengths, np.int64)
        self.start = np.cumsum(size + order) - size
        self.buf = np.full(len(data) + order * len(size), END, np.uint8)
        self.real = np.zeros(len(self.buf), bool)
        for at, a, n in zip(self.start.tolist(), (np.cumsum(size) - size).tolist(), lengths, strict=True):
            self.buf[at : at + n], self.real[at : at + n] = data[a : a + n], True

    def segments(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(document of each gram, grams, document of each word, word hashes), segments ending between words."""
        a = 0
        while a < len(self.buf):
            b = min(a + SEGMENT, len(self.buf))
            while b < len(self.buf) and not _SPACE[self.buf[b - 1]]:
                gaps = np.flatnonzero(_SPACE[self.buf[b : b + SEGMENT]])
                b = b + int(gaps[0]) + 1 if len(gaps) else min(b + SEGMENT, len(self.buf))
            at = a + np.flatnonzero(self.real[a:b])
            gram = self.buf[at].astype(np.uint64)
            for k in range(self.order):
                gram |= self.buf[at - 1 - k].astype(np.uint64) << np.uint64(56 - 8 * k)
            inside = np.clip(self.start, a, b) - a
            h, first = word_hashes(self.buf[a:b], np.concatenate([inside, [b - a]]))
            yield np.searchsorted(self.start, at, "right") - 1, gram, np.repeat(np.arange(len(self.start)), np.diff(first)), h | np.uint64(1)
            a = b


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


class Tally:
    """Distinct keys of one piece; keys of training texts count, others are only asked for."""

    def __init__(self, flag: np.uint64) -> None:
        self.flag, self.parts, self.held = flag, [], 0

    def add(self, keys: np.ndarray, learn: np.ndarray) -> None:
        keys, n = np.unique(np.where(learn, keys | self.flag, keys & ~self.flag), return_counts=True)
        self.parts.append((keys & ~self.flag, np.where(keys & self.flag, n, 0)))
        self.held += len(keys)
        if self.held > 1 << 22:
            self.parts = [self.all()]
            self.held = len(self.parts[0][0]) // 2  # merge again once as many have come in

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True))) if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def packed(a: np.ndarray, rising: bool = False) -> bytes:
    """8-byte numbers (rising ones as differences) by byte planes, compressed."""
    a = np.diff(a, prepend=a.dtype.type(0)) if rising else a
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(a).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(rows: list[bytes], kind: str, rising: bool = False) -> np.ndarray:
    """The numbers of packed rows, one after another."""
    out = [np.zeros(0, kind)]
    for r in rows:
        n = int.from_bytes(r[:8], "little")
        planes = pa.decompress(r[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
        a = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(kind).ravel()
        out.append(np.cumsum(a, dtype=a.dtype) if rising else a)
    return np.concatenate(out)


class Lookup:
    """Values by distinct 64-bit key: one probe of an open table, a binary search for the few keys that lost their slot."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]
        bits = max(4, int(4 * len(self.keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.zeros(1 << bits, np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(self.keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0)
        at = self.slots[self._slot(keys)]
        lost = np.flatnonzero(self.keys[at] != keys)
        at[lost] = np.searchsorted(self.keys, keys[lost])
        if (self.keys[np.minimum(at[lost], len(self.keys) - 1)] != keys[lost]).any():
            raise RuntimeError("a gram or word was not asked for")
        return self.values[at]


def _mask(k: int) -> np.uint64:
    """Of a gram, the last k bytes of its context."""
    return np.uint64(((1 << 64) - 1) ^ ((1 << (64 - 8 * k)) - 1))


_SYMBOL = np.uint64(0xFF)


class Level:
    """Nodes of one order: contexts, counts, symbols; their edges; and the parent's counts and symbols left over."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, k: int) -> None:
        self.k = k
        self.edges, self.n = summed(grams & (_mask(k) | _SYMBOL), counts)
        context = self.edges & _mask(k)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        self.first, self.nodes = first, context[first]
        self.total = np.add.reduceat(self.n, first) if len(first) else self.n
        self.symbols = np.diff(np.concatenate([first, [len(context)]])) if len(first) else first
        self.left = None

    def exclude_from(self, parent: Level) -> None:
        if not len(self.first):
            self.left = (self.total, self.symbols)
            return
        n = parent.n[np.searchsorted(parent.edges, self.edges & (_mask(self.k - 1) | _SYMBOL))]
        at = np.searchsorted(parent.nodes, self.nodes & _mask(self.k - 1))
        self.left = (parent.total[at] - np.add.reduceat(n, self.first), parent.symbols[at] - self.symbols)

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def code_lengths(grams: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray], order: int) -> np.ndarray:
    """log10 probability of each gram's byte in its context.

    grams are distinct and complete for the contexts' last two bytes that occur among them; those that count 0 are asked
    for only. low: all order-1 grams of the training texts, summed.
    """
    seen = counts > 0
    levels = [Level(*low, 0), Level(*low, 1)] + [Level(grams[seen], counts[seen], k) for k in range(2, order + 1)]
    for child, parent in zip(levels[1:], levels[:-1], strict=True):
        child.exclude_from(parent)
    out, done = np.zeros(len(grams)), np.zeros(len(grams), bool)
    child, has_child = np.zeros(len(grams), np.int64), np.zeros(len(grams), bool)
    for k in range(order, -1, -1):
        level = levels[k]
        node, known = Level.find(level.nodes, grams & _mask(k))
        if not known.any():
            continue
        edge, hit = Level.find(level.edges, grams & (_mask(k) | _SYMBOL))
        total, symbols = level.total[node].astype(float), level.symbols[node].astype(float)
        if has_child.any():
            left = levels[k + 1].left
            total[has_child], symbols[has_child] = left[0][child[has_child]], left[1][child[has_child]]
        coded = ~done & known & hit
        out[coded] += np.log10((level.n[edge[coded]] - 0.5) / total[coded])
        done |= coded
        escapes = ~done & known & (symbols > 0)  # where no symbol is left, the escape is certain
        out[escapes] += np.log10(symbols[escapes] / 2 / total[escapes])
        child, has_child = node, known
    out[~done] -= np.log10(max(SYMBOLS - len(levels[0].edges), 1))
    return out


def _deal(keys: np.ndarray, n: int, suffix: bool = False) -> list[np.ndarray]:
    """Places of rising keys in each of n buckets, by a hash of the keys or of their contexts' last two bytes."""
    bucket = (mix64(keys >> np.uint64(48) if suffix else keys) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.searchsorted(bucket[order], np.arange(1, n)))


def _dealt(kind: str, keys: np.ndarray, values: np.ndarray, n: int, suffix: bool = False) -> Iterator[tuple[str, int, bytes, bytes, int, int]]:
    """Rows (kind, bucket, keys, values, sum, positive ones) of rising keys."""
    for b, some in enumerate(_deal(keys, n, suffix)):
        if len(some):
            yield kind, b, packed(keys[some], rising=True), packed(values[some]), int(values[some].sum()), int((values[some] > 0).sum())


_ROWS = pa.schema([("kind", pa.string()), ("b", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary()), ("total", pa.int64()), ("known", pa.int64())])
_ASKED = pa.schema([("p", pa.int64()), ("kind", pa.string()), ("b", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary())])
_ANSWERS = pa.schema([("p", pa.int64()), ("kind", pa.string()), ("b", pa.int32()), ("vals", pa.binary())])
_KINDS = "kind string, b int, keys binary, vals binary, total long, known long"


def _table(rows: list[tuple], schema: pa.Schema = _ROWS) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)


def numbers(t: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of packed rows."""
    return unpacked(t.column("keys").to_pylist(), "<u8", rising=True), unpacked(t.column("vals").to_pylist(), kind)


def score_documents(docs: DataFrame, learn: Column, order: int = 5, piece: int = PIECE_BYTES, bucket: int = BUCKET_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score, score of every document.

    learn: a condition over doc_id, true for the documents that train the model. score is the model's log10 probability of the
    document's words and end; base_score that of a unigram model over words with 0.1 added to each count and one unknown
    word. Tokens are words and one end; n_known of them occur in training texts, which hold train_tokens. order: 2 to 6.

    Null and empty texts have their end only. Very long texts are counted and scored in segments. Repeated rows, and rows
    of equal or null ids, count each time. Without training texts every byte costs the same. An empty table gives no
    rows; other columns play no part. Words are known by 63 bits of hash, grams exactly.
    """
    if not 2 <= order <= 6:
        raise ValueError("order must lie between 2 and 6")
    spark = docs.sparkSession
    small_batches(spark)
    given = columns(docs, doc_id=key, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    given = given.select("doc_id", F.coalesce(learn, F.lit(False)).alias("learned"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, task, docs_ = 0, 0, TaskContext.get().partitionId(), []

        def told() -> pa.RecordBatch:
            ids, learned, n, streams = zip(*docs_, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + at]), pa.array([ids], pa.list_(pa.int64())), pa.array([learned], pa.list_(pa.bool_())), pa.array([n], pa.list_(pa.int64())), pa.array([list(map(len, streams))], pa.list_(pa.int64())), pa.array([pa.compress(b"".join(streams), codec="zstd", asbytes=True)], pa.binary())],
                ["p", "doc_id", "learned", "n_tokens", "bytes", "streams"],
            )

        for batch in batches:
            rows = canonical(*bytes_of(batch.column(2)))
            for i, learned, (stream, n) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), rows, strict=True):
                if docs_ and held + len(stream) > piece:
                    yield told()
                    at, held, docs_ = at + 1, 0, []
                held += len(stream)
                docs_.append((i, learned, n + 1, stream))
        if docs_:
            yield told()

    pieces = materialise(given.mapInArrow(cut, "p long, doc_id array<long>, learned array<boolean>, n_tokens array<long>, bytes array<long>, streams binary"), "pieces")
    count = F.size(F.filter("learned", lambda x: x)).cast("long")
    sizes = pieces.agg(F.coalesce(F.sum(count), F.lit(0)).alias("ends"), F.coalesce(F.sum(F.aggregate("bytes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("bytes")).first()
    # About a byte of packed grams and words for each byte of text.
    buckets = max(n_partitions(spark), -(-sizes.bytes // bucket))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                p, learned, streams = (batch.column(c)[i] for c in range(3))
                learned, texts = np.array(learned.as_py()), Texts(streams.as_py(), batch.column(3)[i].as_py(), order)
                grams, words = Tally(_LEARN), Tally(np.uint64(1))
                for doc, gram, of, word in texts.segments():
                    grams.add(gram, learned[doc])
                    words.add(word, learned[of])
                rows = [(p.as_py(), *row[:4]) for kind, tally in (("gram", grams), ("word", words)) for row in _dealt(kind, *tally.all(), buckets)]
                yield from _table(rows, _ASKED).to_batches()

    asked = materialise(pieces.select("p", "learned", "streams", "bytes").mapInArrow(ask, "p long, kind string, b int, keys binary, vals binary"), "asked")

    def add_up(at: tuple, t: pa.Table) -> pa.Table:
        kind = at[0].as_py()
        keys, n = summed(*numbers(t, "<i8"))
        rows = list(_dealt(kind, keys, n, buckets, suffix=kind == "gram"))
        if kind == "word":
            rows = [(kind, at[1].as_py(), packed(keys, rising=True), packed(n), int(n.sum()), int((n > 0).sum()))]
        elif (n > 0).any():
            low = summed(keys[n > 0] & (_mask(1) | _SYMBOL), n[n > 0])
            rows += _dealt("low", *low, 1)
        return _table(rows)

    totals = materialise(asked.select("kind", "b", "keys", "vals").groupBy("kind", "b").applyInArrow(add_up, _KINDS), "totals")
    words = totals.where("kind = 'word'").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("known"), F.lit(0)).alias("v")).first()
    train_tokens, distinct = words.n + sizes.ends, words.v + (sizes.ends > 0)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = numbers(pa.table([*batch.columns], ["keys", "vals"]), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["gram", "n"])

    # Order-1 grams: 256 x 256 at most.
    rows = totals.where("kind = 'low'").select("keys", "vals").mapInArrow(unpack, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    low = spark.sparkContext.broadcast(summed(np.array([r.gram for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.int64)))

    def price(at: tuple, t: pa.Table) -> pa.Table:
        keys, n = summed(*numbers(t, "<i8"))
        return _table(list(_dealt("gram", keys, code_lengths(keys, n, low.value, order), buckets)))

    priced = totals.where("kind = 'gram'").groupBy("b").applyInArrow(price, _KINDS).unionByName(totals.where("kind = 'word'"))

    def answer(at: tuple, ask_: pa.Table, told: pa.Table) -> pa.Table:
        kind, b = (x.as_py() for x in at)
        value = Lookup(*numbers(told, "<f8" if kind == "gram" else "<i8"))
        keys = (unpacked([k], "<u8", rising=True) for k in ask_.column("keys").to_pylist())
        return _table([(p, kind, b, packed(value(k))) for p, k in zip(ask_.column("p").to_pylist(), keys, strict=True)], _ANSWERS)

    answers = asked.select("p", "kind", "b", "keys").groupBy("kind", "b").cogroup(priced.select("kind", "b", "keys", "vals").groupBy("kind", "b")).applyInArrow(answer, "p long, kind string, b int, vals binary")
    ends, unit = sizes.ends, float(np.log10(train_tokens + 0.1 * (distinct + 1)))

    def score(at: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        row = t.to_pylist()[0]
        texts, n = Texts(row["streams"], row["bytes"], order), len(row["doc_id"])
        rows = {(k, b): v for k, b, v in zip(*(told.column(c).to_pylist() for c in ("kind", "b", "vals")), strict=True)}

        def values(kind: str, tally: Tally) -> Lookup:
            """The answers, which come in the order in which this piece asked."""
            keys = tally.all()[0]
            out = np.zeros(len(keys), "<f8" if kind == "gram" else "<i8")
            for b, some in enumerate(_deal(keys, buckets)):
                if len(some):
                    out[some] = unpacked([rows[kind, b]], out.dtype.str)
            return Lookup(keys, out)

        grams, words = Tally(_LEARN), Tally(np.uint64(1))
        for _, gram, _, word in texts.segments():
            grams.add(gram, np.False_)
            words.add(word, np.False_)
        price_of, count_of = values("gram", grams), values("word", words)
        base, known, total = np.full(n, np.log10(ends + 0.1)), np.full(n, int(ends > 0)), np.zeros(n)
        for doc, gram, of, word in texts.segments():
            total += np.bincount(doc, price_of(gram), n)
            count = count_of(word & ~np.uint64(1))
            base += np.bincount(of, np.log10(count + 0.1), n)
            known += np.bincount(of, count > 0, n).astype(np.int64)
        tokens = np.array(row["n_tokens"], np.int64)
        return pa.table([pa.array(row["doc_id"], pa.int64()), pa.array(row["learned"]), pa.array(tokens), pa.array(known.astype(np.int64)), pa.array(np.full(n, train_tokens)), pa.array(base - tokens * unit), pa.array(total)], ["doc_id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return pieces.groupBy("p").cogroup(answers.groupBy("p")).applyInArrow(score, "doc_id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
