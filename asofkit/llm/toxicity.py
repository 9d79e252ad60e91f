"""Toxicity scores from a learned lexicon, its misspellings, and the words around each hit.

The lexicon holds words, and stems that open words, which a bounded labelled sample shows far more often in toxic
documents. It forms a trie; a Levenshtein automaton run through the trie finds misspelled terms, and swapped neighbours
count as one edit. A term that several ordinary words of the sample come near to bears no such edits, and those words are
no misspellings. Each distinct word of a batch is matched once. A window around each hit tells quotation (quote marks,
learned words of reporting) from abuse, and a small logistic regression turns a document's hits into a score; misspelled
terms count by a fixed share of their weight.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, byte_hashes, bytes_of, columns, crc_fold, discard, materialise, mix64, set_shingles, slices_by_bytes, small_batches, word_hashes

#: Characters trimmed from words, and those of them that mark quotation.
QUOTES = "\"“”„«»‹›‘’"
TRIM = QUOTES + "'`.,;:!?()[]{}<>*_~|/\\-–—…&#@%+="
STEMS = (4, 5, 6)
WINDOW = 6
#: Share of a hit's effect by its edits.
EDITED = (1.0, 0.95, 0.6)
#: Ordinary words near a term that its misspellings can bear.
NEIGHBOURS = 5


class Trie:
    """A trie of (term, number); match() runs the Levenshtein automaton of a word through it. limits: edits that terms may
    bear, where they differ from what their length allows."""

    def __init__(self, terms: list[tuple[str, int]], limits: dict[str, int] | None = None) -> None:
        self.limits = {t: (limits or {}).get(t, allowed(len(t))) for t, _ in terms}
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, int] | None] = [None]
        for text, number in terms:
            node = 0
            for c in text:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(None)
                node = self.next[node][c]
            self.ends[node] = (text, number)

    def match(self, word: str, most: int) -> tuple[int, int] | None:
        """Number of the nearest term within `most` edits (insert, delete, replace) and the term's own allowance, and
        its distance; ties to the longest term."""
        found = [(far, -len(text), number) for text, number, far in self.reach(word, most)]
        return (min(found)[2], min(found)[0]) if found else None

    def reach(self, word: str, most: int) -> list[tuple[str, int, int]]:
        """All terms within reach with their numbers and distances.

        The automaton's state after each trie letter is the row of edit distances to all openings of the word; branches
        whose row exceeds the bound are cut.
        """
        found = []
        stack = [(0, list(range(len(word) + 1)))]
        while stack:
            node, row = stack.pop()
            if end := self.ends[node]:
                text, number = end
                if row[-1] <= min(most, self.limits[text]):
                    found.append((text, number, row[-1]))
            for c, child in self.next[node].items():
                new = [row[0] + 1]
                for j, w in enumerate(word):
                    new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (w != c)))
                if min(new) <= most:
                    stack.append((child, new))
        return found


def allowed(length: int) -> int:
    """Edits that a term of this length may bear."""
    return 0 if length < 5 else 1 if length < 9 else 2


@dataclass
class Model:
    """Lexicon with weights, words of reporting around hits, the regression over a document's features, edits that terms
    may bear (else by length), and ordinary words near terms."""

    terms: list[tuple[str, bool]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    around: dict[str, float] = field(default_factory=dict)
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(5))
    edits: dict[str, int] = field(default_factory=dict)
    ordinary: list[str] = field(default_factory=list)

    def limit(self, term: str) -> int:
        return self.edits.get(term, allowed(len(term)))


class Matcher:
    """Finds lexicon hits in batches of texts; words that cannot be near a term are told apart by their ends."""

    def __init__(self, model: Model) -> None:
        self.model, self.number = model, {t: i for i, (t, _) in enumerate(model.terms)}
        words = [t for t, stem in model.terms if not stem]
        bearing = [t for t in words if model.limit(t)]
        self.trie = Trie([(t, self.number[t]) for t in bearing], model.edits)
        self.known: dict[str, tuple[int, int] | None] = {}
        swapped = {t[:i] + t[i + 1] + t[i] + t[i + 2 :]: t for t in sorted(bearing, key=lambda t: (len(t), t), reverse=True) for i in range(len(t) - 1)}
        self.swaps = {w: self.number[t] for w, t in swapped.items() if w not in self.number}
        self.ordinary = pa.array(model.ordinary, pa.string())
        self.exact = pa.array(words, pa.string())
        self.stems = {n: pa.array([t for t, stem in model.terms if stem and len(t) == n], pa.string()) for n in STEMS}
        # Of a term cut into one part more than the edits it may bear, a word within reach keeps at least one part: the
        # first at its start, the last at its end, or a middle one somewhere.
        self.near: list[tuple[int, int, int, pa.Array, pa.Array, str]] = []
        for length, d in sorted({(len(t), model.limit(t)) for t in bearing}):
            some = [t for t in bearing if (len(t), model.limit(t)) == (length, d)]
            h = length // (d + 1)
            heads, tails = ({t[:h] for t in some}, {t[length - h :] for t in some})
            middle = "|".join(sorted({_literal(t[h * k : h * (k + 1)]) for t in some for k in range(1, d)}))
            self.near.append((length, d, h, pa.array(sorted(heads), pa.string()), pa.array(sorted(tails), pa.string()), middle))

    def candidates(self, words: pa.Array) -> np.ndarray:
        """Which distinct words may be a misspelled term, and so need the automaton."""
        out, size = np.zeros(len(words), bool), np.asarray(pc.utf8_length(words))
        has = lambda values, terms: np.asarray(pc.is_in(values, value_set=terms))
        for length, d, h, heads, tails, middle in self.near:
            fits = np.flatnonzero(np.abs(size - length) <= d)
            some = words.take(pa.array(fits))
            close = has(pc.utf8_slice_codeunits(some, 0, h), heads) | has(pc.utf8_slice_codeunits(some, -h), tails)
            if middle and len(some):
                close |= np.asarray(pc.match_substring_regex(some, middle))
            out[fits[close]] = True
        return out

    def hits(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Term (or -1) and distance of each distinct word: the word itself, else a stem that opens it, else, unless it is
        an ordinary word, a term with two neighbours swapped (distance 1) or the automaton's nearest term."""
        term, far = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
        if not self.model.terms:
            return term, far
        for values, terms in [(words, self.exact), *((pc.utf8_slice_codeunits(words, 0, n), t) for n, t in self.stems.items())]:
            if len(terms):
                at = np.asarray(pc.fill_null(pc.index_in(values, value_set=terms), -1), np.int64)
                new = (at >= 0) & (term < 0)
                numbers = np.array([self.number[t] for t in terms.to_pylist()])
                term[new] = numbers[at[new]]
        open_ = (term < 0) & ~np.asarray(pc.is_in(words, value_set=self.ordinary))
        if self.swaps:
            swap = np.asarray(pc.fill_null(pc.index_in(words, value_set=pa.array(self.swaps, pa.string())), -1), np.int64)
            swap[~open_] = -1
            term[swap >= 0], far[swap >= 0] = np.fromiter(self.swaps.values(), np.int64)[swap[swap >= 0]], 1
        at = np.flatnonzero(self.candidates(words) & open_ & (term < 0))
        if len(self.known) > 200_000:
            self.known = {}
        for i, w in zip(at.tolist(), words.take(pa.array(at)).to_pylist(), strict=True):
            if w not in self.known:
                self.known[w] = self.trie.match(w, 2 if len(w) >= 7 else 1)
            if self.known[w]:
                term[i], far[i] = self.known[w]
        return term, far


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


@dataclass
class Words:
    """The words of some texts: distinct raw and trimmed words, each word's index, each text's first word."""

    raw: pa.Array
    trimmed: pa.Array
    index: np.ndarray
    first: np.ndarray


def cut_words(texts: pa.Array) -> Words:
    """White-space words, lower-cased; marks at their ends are trimmed, marks inside them cut no further."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    for c in "\n\r\t\x0b\x0c ":
        texts = pc.replace_substring(texts, c, " ")
    lists = pc.split_pattern(texts, " ")
    coded = lists.values.dictionary_encode()
    return Words(coded.dictionary, pc.utf8_trim(coded.dictionary, TRIM), np.asarray(coded.indices, np.int64), np.asarray(lists.offsets, np.int64))


@dataclass
class Hits:
    """Hits of some texts: document row, place, term, distance, and whether quote marks stand around the hit."""

    words: Words
    row: np.ndarray
    place: np.ndarray
    term: np.ndarray
    far: np.ndarray
    quoted: np.ndarray


def find_hits(texts: pa.Array, matcher: Matcher) -> Hits:
    w = cut_words(texts)
    term, far = matcher.hits(w.trimmed)
    place = np.flatnonzero(term[w.index] >= 0) if len(w.index) else np.zeros(0, np.int64)
    row = np.searchsorted(w.first, place, side="right") - 1
    if len(place):
        opens = np.asarray(pc.match_substring_regex(w.raw, f"^[{QUOTES}]"))[w.index]
        closes = np.asarray(pc.match_substring_regex(w.raw, f"[{QUOTES}][.,;:!?)]*$"))[w.index]
        low, high = np.maximum(place - WINDOW, w.first[row]), np.minimum(place + WINDOW + 1, w.first[row + 1])
        before = np.array([opens[a : p + 1].any() for a, p in zip(low, place, strict=True)])
        after = np.array([closes[p:b].any() for b, p in zip(high, place, strict=True)])
        quoted = before & after
    else:
        quoted = np.zeros(0, bool)
    return Hits(w, row, place, term[w.index[place]], far[w.index[place]], quoted)


def features(h: Hits, rows: int, model: Model) -> np.ndarray:
    """Per text: 1, weight of exact hits, of near hits, of hits two edits away, and of quoted hits (each as log1p).

    A hit counts by its term's weight and its window: hits in quotation, or among words of reporting (other than hits),
    count less.
    """
    out = np.zeros((rows, 5))
    out[:, 0] = 1
    if len(h.place):
        weight = np.array(model.weights)[h.term]
        if model.around:
            told = np.array([model.around.get(x, 0.0) for x in h.words.trimmed.to_pylist()])[h.words.index]
            told[h.place] = 0
            low = np.maximum(h.place - WINDOW, h.words.first[h.row])
            high = np.minimum(h.place + WINDOW + 1, h.words.first[h.row + 1])
            sums = np.concatenate([[0.0], np.cumsum(told)])
            weight = weight / (1 + np.exp(np.clip(sums[high] - sums[low], -4, 8))) * 2
        column = np.where(h.quoted, 4, 1 + np.minimum(h.far, 2))
        np.add.at(out, (h.row, column), weight)
        out[:, 1:] = np.log1p(out[:, 1:])
    return out


def _counted(batches: Iterator[pa.RecordBatch], kinds: tuple[int, ...]) -> dict[tuple[int, str], list[int]]:
    """Documents, by label, that hold each word (kind 0) or opening of so many letters."""
    found: dict[tuple[int, str], list[int]] = defaultdict(lambda: [0, 0])
    for batch in batches:
        for a, b in slices_by_bytes(batch.column(1), 4 << 20):
            toxic = np.asarray(batch.column(0).slice(a, b - a)) == 1
            w = cut_words(batch.column(1).slice(a, b - a))
            doc = np.repeat(np.arange(b - a), np.diff(w.first))
            for kind in kinds:
                terms = (w.trimmed if kind == 0 else pc.utf8_slice_codeunits(w.trimmed, 0, kind)).dictionary_encode()
                fits = np.asarray(pc.utf8_length(terms.dictionary)) >= (kind or 3)
                index = np.asarray(terms.indices)[w.index]
                pairs = np.unique(doc * len(terms.dictionary) + index)
                row, term = np.divmod(pairs, max(len(terms.dictionary), 1))
                bad = np.bincount(term[toxic[row]], minlength=len(fits))
                good = np.bincount(term[~toxic[row]], minlength=len(fits))
                for t, x, y, ok in zip(terms.dictionary.to_pylist(), bad.tolist(), good.tolist(), fits.tolist(), strict=True):
                    if ok:
                        one = found[kind, t]
                        one[0] += x
                        one[1] += y
    return found


def train(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = (8000, 16000), lexicon: int = 500, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from at most sample[0] toxic and sample[1] other labelled rows, chosen by a hash of key and text.

    A term enters the lexicon if at least 4 (and 1 in 100) of the sample's toxic texts hold it, between as many different
    pairs of neighbours (so near copies of one text do not make its words terms), and if it is at least 20 times as
    frequent among them as among the others; the lexicon's size is a parameter of the model, strongest terms first.
    Equal and most near-equal texts of a label count once, so do repeated labels of a key (toxic if any is). Rows without key, label or text
    teach nothing; other columns, whatever their names, play no part. Without rows of both labels the model is empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    given = columns(labels, id=key, toxic=label).where("id is not null and toxic is not null")
    turn = given.groupBy("id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).withColumn("turn", F.xxhash64("id"))
    chosen = turn.where("toxic = 1").orderBy("turn", "id").limit(sample[0]).unionByName(turn.where("toxic = 0").orderBy("turn", "id").limit(sample[1]))
    # A key may name many rows, so the rows are bounded too.
    known = materialise(chosen.select("id", "toxic"), "chosen")
    found = columns(docs, id=key, text=text).join(F.broadcast(known), "id")
    counts = {r.toxic: r.n for r in found.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(1) or not counts.get(0):
        return Model()
    rows = found.where("text is not null").select("toxic", "id", F.col("text").cast("string").alias("text"))
    some = bounded_sample(rows, "toxic", {1: sample[0], 0: sample[1]}, {v: counts[v] for v in (0, 1)})
    rows = materialise(_without_copies(some.select("toxic", "text")), "sample")
    discard(some, known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _counted(batches, (0, *STEMS))
        if found:
            kinds, terms = zip(*found, strict=True)
            bad, good = zip(*found.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(terms, pa.string()), pa.array(bad, pa.int64()), pa.array(good, pa.int64())], ["kind", "term", "bad", "good"])

    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = n.get(1, 0), n.get(0, 0)
    if not n_bad or not n_good:
        return Model()
    rate = (F.col("bad") / n_bad) / ((F.col("good") + 0.2) / n_good)
    strong = (
        rows.mapInArrow(count, "kind int, term string, bad long, good long")
        .groupBy("kind", "term")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .where((F.col("bad") >= max(4, 0.01 * n_bad)) & (rate >= 20))
        .withColumn("strength", F.col("bad") * F.log(rate))
        .orderBy(F.desc("strength"), "kind", "term")
        .collect()  # each is in 1 of 100 toxic texts of the sample: at most 100 times the terms of an average text
    )
    places = _places(rows, [(r.kind, r.term) for r in strong])
    strong = [r for r in strong if places.get((r.kind, r.term), 0) >= max(4, 0.01 * n_bad)][:lexicon]
    model = Model()
    # A stem must stand for more documents than any word that it opens, and then stands for those words and longer stems.
    words = [(r.term, r.bad) for r in strong if not r.kind]
    stems: dict[str, int] = {}
    for r in sorted((r for r in strong if r.kind), key=lambda r: (r.kind, r.term)):
        covered = any(r.term[:n] in stems and r.bad <= 1.2 * stems[r.term[:n]] for n in STEMS if n < r.kind)
        if not covered and r.bad > 1.2 * max((n for w, n in words if w.startswith(r.term)), default=0):
            stems[r.term] = r.bad
    for r in strong:
        if r.term in stems if r.kind else not any(r.term[:n] in stems for n in STEMS):
            model.terms.append((r.term, bool(r.kind)))
            model.weights.append(math.log((r.bad / n_bad) / ((r.good + 0.2) / n_good)))
    _learn_edits(rows, model)
    _learn_windows(rows, model)
    _learn_regression(rows, model)
    discard(rows)
    return model


def _without_copies(rows: DataFrame) -> DataFrame:
    """Of rows (toxic, text) that share the least hash of their five-word shingles, under any of three hashes, one.

    Texts with a similarity of 0.8 share each least hash with that probability, so 1 copy in 100 stays; unlike texts
    seldom share one. Texts without words count as one.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices_by_bytes(batch.column(1)):
                part = batch.slice(a, b - a)
                h, start = set_shingles(*word_hashes(*bytes_of(part.column(1))))
                at = np.minimum(start[:-1], max(len(h) - 1, 0))
                least = [np.where(np.diff(start) > 0, np.minimum.reduceat(mix64(h ^ np.uint64(salt)), at), 0).view(np.int64) if len(h) else np.zeros(b - a, np.int64) for salt in (0, 1, 2)]
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, least)], ["toxic", "text", "m0", "m1", "m2"])

    left = rows.mapInArrow(sketch, "toxic int, text string, m0 long, m1 long, m2 long")
    for m in ("m0", "m1", "m2"):
        left = left.groupBy("toxic", m).agg(F.min_by(F.struct("text", *(x for x in ("m0", "m1", "m2") if x != m)), F.xxhash64("text")).alias("one")).select("toxic", m, "one.*")
    return left.select("toxic", "text")


def _places(rows: DataFrame, terms: list[tuple[int, str]]) -> dict[tuple[int, str], int]:
    """Different pairs of neighbouring words between which toxic documents hold each term; a text's begin or end is a
    neighbour of its own."""
    sets = {kind: pa.array([t for k, t in terms if k == kind], pa.string()) for kind in (0, *STEMS)}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices_by_bytes(batch.column(1), 4 << 20):
                w = cut_words(batch.column(1).slice(a, b - a))
                around = byte_hashes(*bytes_of(w.trimmed))[w.index] if len(w.index) else np.zeros(0, np.uint64)
                whole = byte_hashes(*bytes_of(batch.column(1).slice(a, b - a)))
                for kind, some in sets.items():
                    if not len(some) or not len(around):
                        continue
                    values = w.trimmed if kind == 0 else pc.utf8_slice_codeunits(w.trimmed, 0, kind)
                    number = np.asarray(pc.fill_null(pc.index_in(values, value_set=some), -1), np.int64)[w.index]
                    at = np.flatnonzero(number >= 0)
                    row = np.searchsorted(w.first, at, side="right") - 1
                    before = np.where(at > w.first[row], around[np.maximum(at - 1, 0)], whole[row])
                    after = np.where(at + 1 < w.first[row + 1], around[np.minimum(at + 1, len(around) - 1)], whole[row])
                    with np.errstate(over="ignore"):
                        context = before * np.uint64(3) + after
                    pairs = np.unique(np.stack([number[at], context.view(np.int64)], 1), axis=0)
                    if len(pairs):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), kind, np.int32)), some.take(pa.array(pairs[:, 0])), pa.array(pairs[:, 1])], ["kind", "term", "context"])

    found = rows.where("toxic = 1").mapInArrow(find, "kind int, term string, context long").groupBy("kind", "term").agg(F.count_distinct("context").alias("n"))
    return {(r.kind, r.term): r.n for r in found.collect()}


def _learn_edits(rows: DataFrame, model: Model) -> None:
    """How many edits each term may bear: none that more than NEIGHBOURS different words of documents that are not toxic
    come within, so that misspellings can be told from ordinary words; those near the other terms are kept."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            words = cut_words(batch.column(1)).trimmed.unique()
            near = matcher.candidates(words)
            near |= np.asarray(pc.is_in(words, value_set=pa.array(matcher.swaps, pa.string())))
            exact = np.asarray(pc.is_in(words, value_set=matcher.exact))
            for w in words.filter(pa.array(near & ~exact)).to_pylist():
                got = {t: far for t, _, far in matcher.trie.reach(w, 2)}
                if w in matcher.swaps:
                    got[model.terms[matcher.swaps[w]][0]] = 1
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(list(got)), pa.array(list(got.values()), pa.int32()), pa.array([w] * len(got))], ["term", "far", "word"])

    near = materialise(rows.where("toxic = 0").mapInArrow(find, "term string, far int, word string").distinct(), "near")
    counts = {(r.term, r.far): r.n for r in near.groupBy("term", "far").agg(F.count("*").alias("n")).collect()}  # two rows a term
    for term, stem in model.terms:
        most = 0 if stem else allowed(len(term))
        while most and sum(counts.get((term, d), 0) for d in range(1, most + 1)) > NEIGHBOURS:
            most -= 1
        model.edits[term] = most
    bearing = [(t, m) for t, m in model.edits.items() if m]
    if bearing:  # NEIGHBOURS words a term at most
        kept = rows.sparkSession.createDataFrame(bearing, "term string, most int")
        model.ordinary = sorted({r.word for r in near.join(F.broadcast(kept), "term").where("far <= most").select("word").collect()})
    discard(near)


def _learn_windows(rows: DataFrame, model: Model) -> None:
    """Words, other than hits, that stand around hits of other documents more than around those of toxic ones: words of
    reporting."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, found = Matcher(model), defaultdict(lambda: [0, 0])
        for batch in batches:
            h = find_hits(batch.column(1), matcher)
            toxic, names, hit = batch.column(0).to_pylist(), h.words.trimmed, set(h.place.tolist())
            for r, p in zip(h.row.tolist(), h.place.tolist(), strict=True):
                around = range(max(p - WINDOW, h.words.first[r]), min(p + WINDOW + 1, h.words.first[r + 1]))
                for w in {names[int(h.words.index[k])].as_py() for k in around if k not in hit}:
                    found[w][0 if toxic[r] else 1] += 1
        if found:
            bad, good = zip(*found.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(bad, pa.int64()), pa.array(good, pa.int64())], ["word", "bad", "good"])

    sums = rows.mapInArrow(count, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    told = sums.where("good >= 5 and good > 2 * bad").collect()  # words around hits of the sample
    model.around = {r.word: math.log((r.good + 0.5) / (r.bad + 0.5)) for r in told}


def _learn_regression(rows: DataFrame, model: Model) -> None:
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            x = features(find_hits(batch.column(1), matcher), batch.num_rows, model)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.float64()), *(pa.array(x[:, k]) for k in range(1, 5))], ["y", "a", "b", "c", "d"])

    # Equal feature rows are counted together, so what reaches the driver is small.
    got = rows.mapInArrow(collect, "y double, a double, b double, c double, d double").groupBy("y", *(F.round(c, 3).alias(c) for c in "abcd")).count().collect()
    data = np.array(sorted(tuple(map(float, r)) for r in got))
    y, n = data[:, 0], data[:, 5]
    hits = data[:, 1:4] @ np.array(EDITED)
    c = _newton(np.column_stack([np.ones(len(data)), hits, data[:, 4]]), y, n, np.array([0, 1, 0]))
    quoted = min(max(c[2], 0.0), c[1] / 2)  # a quoted hit never counts against toxicity, nor more than half a hit
    model.coefficients = np.array([c[0], *(c[1] * e for e in EDITED), quoted])


def _newton(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Logistic regression whose coefficients are drawn (weakly) to the prior."""
    c, penalty = np.zeros(len(prior)), np.diag([1e-6, *[1.0] * (len(prior) - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        slope = x.T @ (n * (y - p)) - penalty @ (c - prior)
        c = c + np.clip(np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + penalty, slope), -5, 5)
    return c


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= threshold), hits (terms found) per document.

    A null or empty text scores as a text without hits. Only the text counts, however long; rows of equal or null keys
    and repeated rows are scored apart; other columns, whatever their names, play no part; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        matcher = Matcher(m)
        for batch in batches:
            for a, b in slices_by_bytes(batch.column(1), 4 << 20):
                h = find_hits(batch.column(1).slice(a, b - a), matcher)
                value = 1 / (1 + np.exp(-np.clip(features(h, b - a, m) @ m.coefficients, -30, 30)))
                terms = [[] for _ in range(b - a)]
                for r, t in zip(h.row.tolist(), h.term.tolist(), strict=True):
                    terms[r].append(m.terms[t][0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(value), pa.array(value >= threshold).cast(pa.int32()), pa.array(terms, pa.list_(pa.string()))], ["doc_id", "score", "predicted", "hits"])

    rows = columns(docs, doc_id=key, text=text).withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int, hits array<string>")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """docs without the rows whose whole text scores at least the threshold; all columns and other rows stay as they are.

    Null and empty texts score as texts without hits; repeated rows go or stay together; an empty table stays empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        matcher = Matcher(m)
        for batch in batches:
            for a, b in slices_by_bytes(batch.column(at), 4 << 20):
                part = batch.slice(a, b - a)
                value = 1 / (1 + np.exp(-np.clip(features(find_hits(part.column(at), matcher), b - a, m) @ m.coefficients, -30, 30)))
                yield part.filter(pa.array(value < threshold))

    return docs.mapInArrow(keep, docs.schema)


def held_out(key: str = "doc_id", folds: int = 3, fold: int = 1):
    """Whether a document belongs to the fold that training leaves out; a null key does not."""
    return F.coalesce(crc_fold(key, folds) == fold, F.lit(False))
