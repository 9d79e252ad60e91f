"""Spelling variants: words one edit apart, found by a search scheme over a bidirectional FM-index.

Words that differ by one edit share one half exactly: the first half of the one starts the other, or its second half ends
it. Halves have three code points or more, so words meet where their first three or their last three agree. Each such
group (split where it is large) builds one bidirectional FM-index over its delimited words; a word matches one half
exactly and extends across the other half, allowing one error, and the suffix ranks that remain name the words found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, discard, materialise, small_batches

RUNS = r"[A-Za-zÀ-ÿ]+"
#: Symbols of one index; a larger group is cut into blocks of index and of asking words.
BLOCK = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Wavelet:
    """A wavelet matrix: occurrences of a symbol, and of smaller ones, in ranges of a sequence."""

    def __init__(self, seq: np.ndarray, n_symbols: int) -> None:
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for b in reversed(range(self.bits)):
            bit = (seq >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(seq) - int(self.ones[-1][-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        # Where each symbol starts on the last level, which holds symbols in bit-reversed order.
        self.start = np.full(n_symbols, len(seq))
        found, at = np.unique(seq, return_index=True)
        self.start[found] = at

    def narrow(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of c before lo, and of c and of smaller symbols between lo and hi."""
        less = np.zeros(len(c), np.int64)
        for k, b in enumerate(reversed(range(self.bits))):
            one = ((c >> b) & 1).astype(bool)
            lo1, hi1 = self.ones[k][lo], self.ones[k][hi]
            lo0, hi0 = lo - lo1, hi - hi1
            less += np.where(one, hi0 - lo0, 0)
            lo, hi = np.where(one, self.zeros[k] + lo1, lo0), np.where(one, self.zeros[k] + hi1, hi0)
        return lo - self.start[c], hi - lo, less


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffixes of a text in order, by prefix doubling."""
    n, k = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(n - k, 0)] = rank[k:]
        both = rank * (n + 2) + after
        order = np.argsort(both, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[True], both[order][1:] != both[order][:-1]]))
        if new[order[-1]] == n:
            return order
        rank, k = new, 2 * k


@dataclass
class States:
    """Partial matches: the asking word, the next place of its pattern, and the interval of suffix ranks in both indexes."""

    q: np.ndarray
    i: np.ndarray
    lo: np.ndarray
    rlo: np.ndarray
    size: np.ndarray

    def take(self, at: np.ndarray) -> States:
        return States(self.q[at], self.i[at], self.lo[at], self.rlo[at], self.size[at])

    def moved(self, by: int) -> States:
        return States(self.q, self.i + by, self.lo, self.rlo, self.size)

    @staticmethod
    def joined(parts: list[States]) -> States:
        return States(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("q", "i", "lo", "rlo", "size")))


class BiIndex:
    """FM-indexes of a delimited vocabulary and of its reverse, with intervals kept in step; symbol 0 delimits."""

    def __init__(self, words: list[np.ndarray], n_symbols: int) -> None:
        text = np.concatenate([np.concatenate([[0], w]) for w in words] + [[0]]).astype(np.int64)
        self.n, self.n_symbols = len(text), n_symbols
        self.starts = np.searchsorted(np.sort(text), np.arange(n_symbols))
        self.order = suffix_order(text)
        self.word_at = np.cumsum(text == 0) - 1
        self.before = text[self.order - 1]
        back = text[::-1]
        self.after = back[suffix_order(back) - 1]
        self.left, self.right = Wavelet(self.before, n_symbols), Wavelet(self.after, n_symbols)

    def everywhere(self, q: np.ndarray) -> States:
        zero = np.zeros(len(q), np.int64)
        return States(q, zero, zero, zero, np.full(len(q), self.n))

    def extend(self, s: States, c: np.ndarray, leftwards: bool) -> tuple[States, np.ndarray]:
        """The states with symbol c put before or behind their matches, and which of them still match anything."""
        if leftwards:
            rank, size, less = self.left.narrow(c, s.lo, s.lo + s.size)
            out = States(s.q, s.i, self.starts[c] + rank, s.rlo + less, size)
        else:
            rank, size, less = self.right.narrow(c, s.rlo, s.rlo + s.size)
            out = States(s.q, s.i, s.lo + less, self.starts[c] + rank, size)
        live = size > 0
        return out.take(live), np.flatnonzero(live)

    def symbols(self, s: States, leftwards: bool) -> tuple[np.ndarray, np.ndarray]:
        """(state, symbol) of all symbols that may extend each state; large intervals name the whole alphabet."""
        bwt, lo = (self.before, s.lo) if leftwards else (self.after, s.rlo)
        small = np.flatnonzero(s.size <= self.n_symbols)
        state = np.repeat(small, s.size[small])
        nth = np.arange(len(state)) - np.repeat(np.cumsum(s.size[small]) - s.size[small], s.size[small])
        pairs = np.unique(state * self.n_symbols + bwt[lo[state] + nth])
        large = np.flatnonzero(s.size > self.n_symbols)
        every = (large[:, None] * self.n_symbols + np.arange(self.n_symbols)[None, :]).ravel()
        return np.divmod(np.concatenate([pairs, every]), self.n_symbols)


class Patterns:
    """Symbol sequences of the asking words, one after another."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.size = np.array([len(r) for r in rows], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)

    def at(self, s: States) -> np.ndarray:
        return self.flat[self.start[s.q] + s.i]

    def over(self, s: States) -> np.ndarray:
        return s.i >= self.size[s.q]


def one_error(index: BiIndex, asking: list[np.ndarray], first_half: bool) -> tuple[np.ndarray, np.ndarray]:
    """(asking word, indexed word) that are one edit apart, the edit lying outside the exactly matched half.

    The half next to a word's border is matched from the middle outwards and closed by the delimiter, then the other half
    is crossed in the other direction up to its delimiter. Both patterns end in the delimiter, which is never edited.
    """
    half = [len(w) // 2 for w in asking]
    close = np.zeros(1, np.int64)
    left = [np.concatenate([w[:h][::-1], close]) for w, h in zip(asking, half, strict=True)]
    right = [np.concatenate([w[h:], close]) for w, h in zip(asking, half, strict=True)]
    exact, free = (Patterns(left), Patterns(right)) if first_half else (Patterns(right), Patterns(left))
    s = index.everywhere(np.arange(len(asking)))
    while len(s.q) and not exact.over(s).all():  # words of different lengths close at different steps
        over = exact.over(s)
        on = s.take(~over)
        s = States.joined([s.take(over), index.extend(on, exact.at(on), leftwards=first_half)[0].moved(1)])
    s = States(s.q, np.zeros(len(s.q), np.int64), s.lo, s.rlo, s.size)
    wrong = s.take(np.zeros(0, np.int64))
    found = []
    leftwards = not first_half
    while len(s.q) or len(wrong.q):
        c = free.at(s)
        state, symbol = index.symbols(s, leftwards)
        odd = (symbol != c[state]) & (symbol != 0)
        other, live = index.extend(s.take(state[odd]), symbol[odd], leftwards)
        inner = c != 0
        parts = [index.extend(wrong, free.at(wrong), leftwards)[0].moved(1), other, other.take(inner[state[odd]][live]).moved(1), s.take(inner).moved(1)]
        s = index.extend(s, c, leftwards)[0].moved(1)
        s = s.take(~free.over(s))  # a match without an error is the word itself
        wrong = States.joined(parts)
        done = free.over(wrong)
        found.append((wrong.q[done], index.word_at[index.order[wrong.lo[done]]]))
        wrong = wrong.take(~done)
    q, hit = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    return np.divmod(np.unique(q * max(1, len(index.order)) + hit), max(1, len(index.order)))


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n), both ways: pairs of words (word, n) of six code points or more that are one edit apart.

    words holds each word once and must be a written table. A pair comes up once or twice.
    """
    size = F.length("word") + 1
    keyed = words.select("word", "n", F.explode(F.array(F.lit("first"), F.lit("last"))).alias("side"))
    keyed = keyed.withColumn("key", F.when(F.col("side") == "first", F.substring("word", 1, 3)).otherwise(F.expr("right(word, 3)")))
    counted = keyed.groupBy("side", "key").agg(F.sum(size).alias("symbols"))
    # Keys with more symbols than a block: one for each block of the vocabulary at most, and no more than the alphabet has triples.
    large = counted.where(F.col("symbols") > block).select(F.col("side").alias("side_"), F.col("key").alias("key_"), F.ceil(F.col("symbols") / block).cast("int").alias("parts"))
    total = words.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-2 * total // block))
    dealt = keyed.join(F.broadcast(large), (F.col("side") == F.col("side_")) & (F.col("key") == F.col("key_")), "left")
    dealt = dealt.withColumn("bucket", F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("string")).otherwise(F.concat(F.lit("key "), "key")))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int"))
    place = "struct({} as a, {} as b)"
    visits = f"array_union(transform(sequence(0, coalesce(parts, 1) - 1), x -> {place.format('own', 'x')}), transform(sequence(0, coalesce(parts, 1) - 1), x -> {place.format('x', 'own')}))"
    dealt = dealt.withColumn("at", F.explode(F.expr(visits))).select("side", "bucket", "at.a", "at.b", "word", "n", "own")

    def search(key: tuple, t: pa.Table) -> pa.Table:
        side, _, a, b = (k.as_py() for k in key)
        texts, ns, own = t.column("word").to_pylist(), t.column("n").to_pylist(), t.column("own").to_pylist()
        codes = [np.frombuffer(x.encode("utf-32-le"), "<u4") for x in texts]
        alphabet = np.unique(np.concatenate(codes))
        codes = [np.searchsorted(alphabet, c).astype(np.int64) + 1 for c in codes]
        indexed, asking = [i for i, o in enumerate(own) if o == a], [i for i, o in enumerate(own) if o == b]
        q = hit = np.zeros(0, np.int64)
        if indexed and asking:
            q, hit = one_error(BiIndex([codes[i] for i in indexed], len(alphabet) + 1), [codes[i] for i in asking], side == "first")
        return pa.table({"word": pa.array([texts[asking[i]] for i in q], pa.string()), "near": pa.array([texts[indexed[i]] for i in hit], pa.string()), "near_n": pa.array([ns[indexed[i]] for i in hit], pa.int64())})

    return dealt.groupBy("side", "bucket", "a", "b").applyInArrow(search, "word string, near string, near_n long")


def spelling_variants(words: DataFrame, ratio: int = 5, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of each row of words (word, n), which holds each word once.

    Near words are those one inserted, deleted or replaced code point apart; a word's form is its near word of largest n
    (ties: the smallest in code-point order) if that n is at least ratio times its own. The root is the last of the
    forms that follow one another, which grow by the ratio each time, so there are few and no rings. Words of fewer than
    six code points raise an error, as their halves may be shorter than the groups' three.
    """
    small_batches(words.sparkSession)
    least = F.raise_error(F.lit("words need six code points or more")).cast("long")
    words = materialise(words.where("word is not null").select("word", F.when(F.length("word") < 6, least).otherwise(F.col("n")).cast("long").alias("n")), "words")
    near = near_words(words, block).repartition("word").groupBy("word", "near").agg(F.max("near_n").alias("near_n"))
    best = near.groupBy(F.col("word").alias("w")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form"))).alias("best"))
    found = words.join(best, F.col("word") == F.col("w"), "left").withColumn("takes", -F.col("best.minus") >= ratio * F.col("n"))
    formed = materialise(found.select("word", F.when(F.col("takes"), F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("takes"), -F.col("best.minus")).alias("form_n")), "formed")
    links = formed.where("form is not null").select("word", F.col("form").alias("root"))
    written: list[DataFrame] = []
    while True:  # each round doubles how far a word looks
        step = links.alias("a").join(links.alias("b"), F.col("a.root") == F.col("b.word"), "left").select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved"))
        written.append(materialise(step, "roots"))
        links = written[-1].select("word", "root")
        if not written[-1].where("moved").limit(1).count():
            break
    discard(*written[:-1], words)
    roots = links.select(F.col("word").alias("w"), "root")
    return formed.join(roots, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def count_words(docs: DataFrame, least_length: int = 6, least_count: int = 5, drop_every: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): letter runs of whole texts with A-Z lower-cased, and how often they occur.

    Where drop_every divides the crc32 of "<key>:<run>", the run loses the code point at that number modulo its length
    (planted misspellings); rows with a null key have none. Null and empty texts have no words; repeated rows count each
    time; other columns play no part.
    """
    given = columns(docs, id=key, text=text)
    runs = given.select("id", F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUNS), F.lit(0))).alias("run"))
    run = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER))
    runs = runs.select("id", run.alias("run"))
    word = F.col("run")
    if drop_every:
        runs = runs.withColumn("h", F.crc32(F.concat(F.col("id").cast("string"), F.lit(":"), "run").cast("binary")))
        at = F.expr("cast(h % length(run) as int)")
        word = F.when(F.col("h") % drop_every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(word)
    counted = runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)
