"""Pattern spans of texts, the nearest of them, and what is read from them: guidance ranges and sentence facts."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARK = "\x01"
_GAP = r"[ \t\r\n]*"

# Spellings of numbers, scales, joints, metrics, cues and periods that results depend on.
NUMBER = r"\(?-?[$€£]?[ \t\r\n]*(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\)?"
SCALE = r"billion|million|thousand|%|percentage points?|percent|cents|per share"
JOINT = r"to|through|and|[-–—]"
METRICS = {
    "REVENUE": (r"\b(?:revenue|net sales)\b", "USD"),
    "EPS": (r"\b(?:earnings per share|diluted EPS|adjusted EPS|EPS)\b", "USD_PER_SHARE"),
    "MARGIN": (r"\b(?:operating margin|gross margin|EBITDA margin)\b", "PERCENT"),
    "OPERATING_INCOME": (r"\b(?:operating income|adjusted EBITDA|EBITDA)\b", "USD"),
    "FREE_CASH_FLOW": (r"\b(?:free cash flow|operating cash flow)\b", "USD"),
    "CAPEX": (r"\b(?:capital expenditures|capital spending|capex)\b", "USD"),
}
GUIDANCE = r"\b(?:guidance|outlook|forecast|we\s+(?:expect|anticipate|project)|company\s+expects)\b"
PERIOD = r"\b(?:(?:FY|fiscal\s+year|full[- ]year)\s*20\d{2}|20\d{2}\s+(?:fiscal|full)[- ]year|Q[1-4]\s*[- ]?\s*20\d{2}|(?:first|second|third|fourth)\s+quarter(?:\s+of)?\s+20\d{2})\b"
QUARTERS = ("first", "second", "third", "fourth")
FLAGS = {"non_gaap": r"\b(?:non[- ]GAAP|adjusted)\b", "gaap": r"\bGAAP\b", "money": r"[$€£]|\bcents?\b|\bper share\b", "percent": "%"}
FACTORS = {"billion": 1e9, "million": 1e6, "thousand": 1e3}


def _cut(text: Column, pattern: str) -> Column:
    """The parts of a text: gaps and matches (case does not count) in turn, a gap first and last."""
    return F.split(F.regexp_replace(text, F.lit(f"(?i)(?:{pattern})"), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)


def spans(docs: DataFrame, key: str, text: str, kinds: dict[str, str]) -> DataFrame:
    """key, doc, kind, start, end, value: the matches of each kind's pattern (case does not count) in each text.

    Positions count characters from 0. doc tells texts of one key apart; equal texts of a key count once. Each pattern
    marks its matches in one pass; only matches and the lengths between them leave the row, and one shuffle by key and
    doc serves all later windows over a text. Null texts have no spans.
    """
    cut = lambda p: _cut(F.replace(F.col(text), F.lit(_MARK), F.lit(" ")), p)
    every = F.array(*(F.struct(F.lit(k).alias("kind"), cut(p).alias("parts")) for k, p in kinds.items()))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(text).alias("doc"), F.explode(every).alias("k")).where(F.size("k.parts") > 1)
    pick = lambda i: F.struct(F.length(F.get("k.parts", 2 * i)).alias("gap"), F.get("k.parts", 2 * i + 1).alias("value"))
    found = F.transform(F.sequence(F.lit(0), F.floor((F.size("k.parts") - 3) / 2).cast("int")), pick)
    rows = rows.select("key", "doc", "k.kind", F.posexplode(found).alias("pos", "m")).select("key", "doc", "kind", "pos", "m.gap", "m.value")
    rows = rows.repartition("key", "doc").dropDuplicates(["key", "doc", "kind", "pos"])
    upto = Window.partitionBy("key", "doc", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(upto)
    return rows.select("key", "doc", "kind", end.cast("long").alias("end"), "value").select("key", "doc", "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value")


def _nearest(at: np.ndarray, among: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the index of the nearest of some (at least one), ties to the least turn, and its distance."""
    order = np.lexsort((turn, among))
    place, turn = among[order], turn[order]
    ahead = np.searchsorted(place, at)
    behind = np.searchsorted(place, place[np.maximum(np.searchsorted(place, at, "right") - 1, 0)])
    ahead = np.where(ahead < len(place), ahead, behind)
    to_ahead, to_behind = np.abs(place[ahead] - at), np.abs(place[behind] - at)
    best = np.where((to_ahead < to_behind) | ((to_ahead == to_behind) & (turn[ahead] < turn[behind])), ahead, behind)
    return order[best], np.minimum(to_ahead, to_behind)


def _surroundings(metrics: list[str], flags: list[str], within: dict[str, int], around: int):
    """The pass over a batch of texts that gives each range with its nearest metric and period, and flags around both."""

    def run(batches):
        for batch in batches:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            bounds = {name: c.offsets.to_numpy() for name, c in col.items() if name != "key"}
            lengths = {k: col[k].flatten().to_numpy() for k in ("range", "cue", "period", *metrics, *flags)}
            texts, found = [], {"value": [], "metric": [], "period": [], **{f: [] for f in flags}}
            for i in range(batch.num_rows):
                part = lambda name: slice(bounds[name][i] - bounds[name][0], bounds[name][i + 1] - bounds[name][0])  # noqa: B023, E731
                ends = {k: np.cumsum(n[part(k)], dtype=np.int64) for k, n in lengths.items()}
                start, end = ({k: e[first : len(e) - 1 : 2] for k, e in ends.items()} for first in (0, 1))
                middle = {k: (start[k] + end[k]) // 2 for k in start}
                named = [k for k in metrics if len(start[k])]
                if not (len(start["range"]) and len(start["cue"]) and len(start["period"]) and named):
                    continue
                at = middle["range"]
                m_start, m_end, m_at = (np.concatenate([of[k] for k in named]) for of in (start, end, middle))
                kind = np.repeat([metrics.index(k) for k in named], [len(start[k]) for k in named])
                turn = np.empty(len(kind), np.int64)
                turn[np.lexsort((m_end, m_start, kind))] = np.arange(len(kind))
                period = np.unique(np.array(col["periods"][i].as_py(), object), return_inverse=True)[1]
                metric, m_away = _nearest(at, m_at, turn)
                cue_away = _nearest(at, middle["cue"], np.zeros(len(middle["cue"])))[1]
                when, p_away = _nearest(at, middle["period"], period)
                kept = np.flatnonzero((cue_away <= within["cue"]) & (m_away <= within["metric"]) & (p_away <= within["period"]))
                metric, when = metric[kept], when[kept]
                since, until = np.minimum(start["range"][kept], m_start[metric]) - around, np.maximum(end["range"][kept], m_end[metric]) + around
                texts.append(np.full(len(kept), i))
                found["value"].append(kept + part("ranges").start)
                found["metric"].append(kind[metric])
                found["period"].append(when + part("periods").start)
                for f in flags:  # matches of a flag follow one another, so the first from there on ends first
                    found[f].append(np.append(end[f], np.iinfo(np.int64).max)[np.searchsorted(start[f], since)] <= until)
            if texts:
                got = {k: np.concatenate(v) for k, v in found.items()}
                out = [col["key"].take(pa.array(np.concatenate(texts))), col["ranges"].flatten().take(pa.array(got["value"])), pa.array(metrics, pa.string()).take(pa.array(got["metric"])), col["periods"].flatten().take(pa.array(got["period"]))]
                yield pa.RecordBatch.from_arrays([*out, *(pa.array(got[f]) for f in flags)], ["key", *found])

    return run


def amount(value: Column) -> Column:
    """The number of a spelling such as $1,200.5 or (0.20), brackets on both sides or a minus sign being negative."""
    plain = F.regexp_replace(value, r"[^0-9.]", "").cast("double")
    return F.when(value.contains("-") | (value.startswith("(") & value.endswith(")")), -plain).otherwise(plain)


def period_name(value: Column) -> Column:
    """FY2025 or Q3-2024 of a period's spelling."""
    v = F.lower(value)
    year = F.regexp_extract(v, r"20\d{2}", 0)
    quarter = F.regexp_extract(v, r"^q([1-4])", 1)
    for n, word in enumerate(QUARTERS, 1):
        quarter = F.when(v.startswith(word), F.lit(str(n))).otherwise(quarter)
    return F.when(quarter != "", F.concat(F.lit("Q"), quarter, F.lit("-"), year)).otherwise(F.concat(F.lit("FY"), year))


def extract_ranges(
    docs: DataFrame,
    key: str,
    text: str,
    metrics: dict[str, tuple[str, str]] = METRICS,
    cue: str = GUIDANCE,
    cue_within: int = 500,
    metric_within: int = 120,
    period_within: int = 350,
    around: int = 220,
    per_share_limit: float = 100.0,
) -> DataFrame:
    """key, metric, period, basis, unit, low, high of numeric ranges near a guidance cue, a metric and a named period.

    metrics: name to (pattern, unit), the unit being USD (needs a scale word), USD_PER_SHARE (a sign of money within its
    surroundings, no bound above the limit) or PERCENT (a percent sign or word). A range takes the metric, cue and period
    whose centre is nearest to its own; farther ones than the limits don't count, and a range without any of the three
    gives no row. A bound without a scale takes the other's; bounds in the wrong order are swapped. The basis is
    NON_GAAP, GAAP or UNSPECIFIED by the words within `around` characters of range and metric. Equal rows count once;
    null texts give none. Plain digits of any length are one number.
    """
    names = sorted(metrics)
    whole = rf"{NUMBER}{_GAP}(?:{SCALE})?{_GAP}(?:{JOINT}){_GAP}{NUMBER}(?:{_GAP}(?:{SCALE}))?"
    kinds = {"range": whole, "cue": cue, "period": PERIOD, **{f"metric {m}": metrics[m][0] for m in names}, **FLAGS}
    any_metric = "|".join(p for p, _ in metrics.values())
    t = F.col(text)
    likely = docs.where(F.regexp_like(t, F.lit(f"(?i){cue}")) & F.regexp_like(t, F.lit(f"(?i){any_metric}")) & F.regexp_like(t, F.lit(f"(?i){PERIOD}")))
    # Each text's matches are set against each other where the text is read: no shuffle, and no more memory than a batch.
    clean = likely.select(F.col(key).alias("key"), F.replace(t, F.lit(_MARK), F.lit(" ")).alias("t"))
    parts = clean.select("key", *(_cut(F.col("t"), p).alias(k) for k, p in kinds.items()))
    matches = lambda k: F.filter(k, lambda _, i: i % 2 == 1)
    held = parts.select("key", *(F.transform(k, F.length).alias(k) for k in kinds), matches("range").alias("ranges"), F.transform(matches("period"), period_name).alias("periods"))
    kernel = _surroundings([f"metric {m}" for m in names], list(FLAGS), {"cue": cue_within, "metric": metric_within, "period": period_within}, around)
    schema = T.StructType([held.schema["key"], *(T.StructField(c, T.StringType()) for c in ("value", "metric", "period")), *(T.StructField(f, T.BooleanType()) for f in FLAGS)])
    ranges = held.mapInArrow(kernel, schema).withColumn("metric", F.substring("metric", 8, 100))

    shape = (rf"(?i)^({NUMBER}){_GAP}({SCALE})?{_GAP}(?:{JOINT}){_GAP}({NUMBER})(?:{_GAP}({SCALE}))?$")
    group = lambda g: F.lower(F.regexp_extract("value", shape, g))
    ranges = ranges.select("key", "metric", "period", *FLAGS, amount(group(1)).alias("a"), group(2).alias("sa"), amount(group(3)).alias("b"), group(4).alias("sb"))
    first, last = (F.when(F.col(own) != "", F.col(own)).otherwise(F.col(other)) for own, other in (("sa", "sb"), ("sb", "sa")))
    ranges = ranges.withColumn("fa", first).withColumn("fb", last)
    units = F.create_map(*(F.lit(x) for m in names for x in (m, metrics[m][1])))
    ranges = ranges.withColumn("unit", units[F.col("metric")])
    scales = F.create_map(*(F.lit(x) for pair in FACTORS.items() for x in pair))
    per_share, percent = F.col("unit") == "USD_PER_SHARE", F.col("unit") == "PERCENT"
    factor = lambda c: F.when(per_share, F.when(c == "cents", 0.01).otherwise(1.0)).when(percent, 1.0).otherwise(F.try_element_at(scales, c))
    fits = F.when(per_share, (F.greatest(F.abs("a"), F.abs("b")) <= per_share_limit) & F.col("money")).when(percent, F.col("fb").startswith("percent") | F.col("percent"))
    ranges = ranges.where(F.coalesce(fits, F.lit(True))).select("*", (F.col("a") * factor(F.col("fa"))).alias("x"), (F.col("b") * factor(F.col("fb"))).alias("y"))
    basis = F.when(F.col("non_gaap"), "NON_GAAP").when(F.col("gaap"), "GAAP").otherwise("UNSPECIFIED")
    return ranges.where("x is not null and y is not null").select("key", "metric", "period", basis.alias("basis"), "unit", F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high")).distinct()


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A sentence ends before a capitalised word or a year.
BOUNDARY = r"(?<=[.!?]) (?=[\"'“‘(]*(?:[A-Z][A-Za-z]|[0-9]{4}(?![A-Za-z0-9_])))"
#: Phrases are compared by these tokens, so white space and hyphens between words are alike.
TOKEN = "[a-z]+|[^a-z -]"


def sentences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n (from 0), sentence of each text, runs of white space being one space."""
    plain = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\t\r\n\f][ \t\r\n\f]*+| [ \t\r\n\f]++", " "))
    # A split is never empty, and the outer form has no filter on its size, for which all texts would be cut twice.
    return docs.select(key, F.posexplode_outer(F.split(plain, BOUNDARY)).alias("n", "sentence"))


def _any_of(folded: list[str]) -> str:
    """The pattern of phrases given as tokens with a space between; letters beside letters need a gap, other tokens may have one."""
    letters = lambda t: "a" <= t[0] <= "z"

    def one(tokens: list[str]) -> str:
        gaps = ["[ -]+" if letters(a) and letters(b) else "[ -]*" for a, b in zip(tokens, tokens[1:])]
        return "".join(re.escape(t) + g for t, g in zip(tokens, [*gaps, ""])) + "(?![a-z])" * letters(tokens[-1])

    words, others = ("|".join(one(p.split(" ")) for p in folded if letters(p) is kind) for kind in (True, False))
    return "(?i)(?:" + ("|".join(filter(None, [words and f"(?<![a-z])(?:{words})", others])) or "(?!)") + ")"


def phrase_hits(rows: DataFrame, text: str, phrases: DataFrame, folded: list[str]) -> DataFrame:
    """rows with phrase, kind, name, start, end of each occurrence of phrases (phrase, kind, name) in short texts.

    phrases holds each of the folded phrases (tokens with a space between); it is broadcast, its size being that of a word
    list. One pass cuts a text wherever a phrase begins; runs of as many tokens as a phrase may have look themselves up
    from there, so overlapping phrases are found too.
    """
    lengths = sorted({len(p.split(" ")) for p in folded})
    cut = F.split(F.regexp_replace(F.replace(F.col(text), F.lit(_MARK), F.lit(" ")), F.lit(f"(?={_any_of(folded)})"), F.lit(_MARK)), _MARK, -1)
    each = rows.withColumn("_parts", cut).select(*rows.columns, "_parts", F.posexplode_outer("_parts").alias("_i", "_part")).where("_i > 0")
    # Each part but the first begins with a token, so as many parts as a phrase has tokens hold it.
    each = each.select(*rows.columns, F.length(F.array_join(F.slice("_parts", F.lit(1), F.col("_i")), "")).alias("start"), F.array_join(F.slice("_parts", F.col("_i") + 1, F.lit(max(lengths, default=1))), "").alias("_from"))
    token = "(?:[a-z]++|[^a-z -])"
    run = lambda n: F.regexp_extract("_from", rf"(?i)^{token}(?:[ -]*+{token}){{{n - 1}}}", 0)
    each = each.select(*rows.columns, "start", F.explode_outer(F.array(*map(run, lengths or [1]))).alias("_run")).where("_run <> ''")
    fold = F.array_join(F.regexp_extract_all(F.translate("_run", _UPPER, _LOWER), F.lit(TOKEN), 0), " ")
    each = each.select(*rows.columns, fold.alias("phrase"), "start", (F.col("start") + F.length("_run")).alias("end"))
    return each.join(F.broadcast(phrases), "phrase").select(*rows.columns, "phrase", "start", "end", "kind", "name")


def sentence_facts(
    docs: DataFrame,
    key: str,
    text: str,
    topics: dict[str, list[str]],
    cues: dict[str, list[str]],
    comparisons: list[str] = (),
    negations: list[str] = (),
    lookback: int = 4,
    within: int = 80,
    least: int = 20,
    most: int = 600,
    digit_share: float = 0.3,
    least_words: int = 4,
    boilerplate: list[str] = (),
) -> DataFrame:
    """key, n, topic, topic_phrases, families, cue_phrases, negated, compared: one row per topic that a sentence names near a cue.

    topics and cues (by family), comparisons and boilerplate are lists of phrases. A sentence counts if its length, its
    share of digits among characters other than white space and its number of words (letter runs) are within the gates
    and no boilerplate phrase stands in it. A cue belongs to a topic if at most `within` characters lie between them;
    negated says whether one of the `lookback` words before any such cue is a negation. Case doesn't count. Equal texts
    of a key count once; null texts have no sentence.
    """
    spark = docs.sparkSession
    fold = lambda p: " ".join(re.findall(TOKEN, p.lower()))
    table = {(fold(p), kind, name) for kind, group in (("topic", topics), ("cue", cues), ("comparison", {"": comparisons})) for name, listed in group.items() for p in listed}
    table = sorted(t for t in table if t[0])
    phrases = spark.createDataFrame(table, "phrase string, kind string, name string")
    any_of = lambda kinds: sorted({p for p, kind, _ in table if kind in kinds})
    s = F.col("sentence")
    solid = F.length(F.replace(s, F.lit(" "), F.lit("")))
    kept = sentences(docs, key, text).where(F.length(s).between(least, most)).where(F.length(s) - F.length(F.regexp_replace(s, "[0-9]+", "")) <= digit_share * solid)
    kept = kept.where(F.regexp_like(s, F.lit(rf"^[^A-Za-z]*+(?:[A-Za-z][A-Za-z'-]*+[^A-Za-z]*+){{{least_words}}}")))
    if boilerplate:
        kept = kept.where(~F.regexp_like(s, F.lit("(?i)" + "|".join(re.escape(p.lower()) for p in boilerplate))))
    # Most sentences name no topic or cue.
    likely = kept.where(F.regexp_like(s, F.lit(_any_of(any_of(["topic"])))) & F.regexp_like(s, F.lit(_any_of(any_of(["cue"])))))
    hits = phrase_hits(likely.withColumn("_same", F.xxhash64("sentence")), "sentence", phrases, any_of(["topic", "cue", "comparison"]))
    # The last words before a cue, read backwards from it.
    before = F.regexp_extract(F.reverse(F.substring(s, F.lit(1), F.col("start"))), rf"(?i)^(?:[^a-z']*+[a-z']++){{0,{lookback}}}", 0)
    last = F.regexp_extract_all(F.translate(F.reverse(before), _UPPER, _LOWER), F.lit("[a-z']+"), 0)
    negated = F.arrays_overlap(last, F.array(*(F.lit(w.lower()) for w in negations))) if negations else F.lit(False)
    hits = hits.withColumn("negated", F.when(F.col("kind") == "cue", F.coalesce(negated, F.lit(False))))
    hit = F.struct("name", "phrase", "start", "end", "negated")
    of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, hit)).alias(kind)
    whole = hits.groupBy(key, "n", "_same").agg(of("topic"), of("cue"), F.bool_or(F.col("kind") == "comparison").alias("compared"))
    each = whole.withColumn("_topic", F.explode(F.array_sort(F.array_distinct(F.transform("topic", lambda t: t["name"])))))
    own = F.filter("topic", lambda t: t["name"] == F.col("_topic"))
    gap = lambda t, c: F.greatest(t["start"] - c["end"], c["start"] - t["end"], F.lit(0))
    each = each.withColumn("_own", own).withColumn("_cues", F.filter("cue", lambda c: F.exists("_own", lambda t: gap(t, c) <= within))).where(F.size("_cues") > 0)
    names = lambda c, f: F.array_sort(F.array_distinct(F.transform(c, lambda x: x[f])))
    return each.select(key, "n", F.col("_topic").alias("topic"), names("_own", "phrase").alias("topic_phrases"), names("_cues", "name").alias("families"), names("_cues", "phrase").alias("cue_phrases"), F.exists("_cues", lambda c: c["negated"]).alias("negated"), "compared").distinct()
