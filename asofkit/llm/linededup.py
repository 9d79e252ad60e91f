"""Line dedup by a suffix array over line-id sequences; DataFrame functions only.

Rows are numbered and written once. Lines that occur more than once get an id each, so a document is a sequence of line
ids, broken where a line occurs nowhere else. Prefix doubling ranks the suffixes of all sequences by their first 1, 2,
4 ... lines, for the sequences as they are and read backwards.

Every repeated run of min_words words is covered by its shortest parts of min_words words, counted from each of its lines
forwards and backwards; they are at most min_words lines long, so the suffixes need no deeper order. The suffixes are
range-sorted by rank and then by place in the corpus. The longest common prefix of two neighbours follows from their
doubled ranks, halving the step each time. A scan over the array opens an interval wherever that prefix is shorter than
the suffix's shortest part; the suffixes of an interval are the copies of one part, the earliest stays, and the lines of
the others are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, join_spread, materialise, numbered


def cut_lines(text: Column) -> Column:
    """The lines of a text that hold words, as an array of (pos, a, b, words): place among all lines, two independent
    64-bit hashes, number of words."""
    each = F.transform(F.split(text, "\n", -1), lambda s, i: F.struct(i.alias("pos"), F.xxhash64(s).alias("a"), F.xxhash64(F.lit("line"), s).alias("b"), F.regexp_count(s, F.lit(WORD)).alias("words")))
    return F.filter(each, lambda x: x["words"] > 0)


def repeated_lines(rows: DataFrame, least: int = 0) -> DataFrame:
    """rows (row, doc, text) as the lines that occur more than once, in stretches of at least `least` words: doc, row, pos (place in the text), j (place among the
    lines with words), line (its id), words, seg (stretch of consecutive repeated lines), at (words of the stretch before
    the line), length (words of the stretch).

    Lines are told apart by 128 bits of hash. Null and empty texts have no lines; an empty table gives no rows; rows of
    equal or null doc are documents of their own, told apart by row.
    """
    lines = materialise(rows.select("doc", "row", F.posexplode(cut_lines(F.col("text"))).alias("j", "x")).select("doc", "row", "j", "x.pos", "x.a", "x.b", "x.words"), "lines")
    ids = materialise(lines.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").withColumn("line", F.monotonically_increasing_id()), "line-ids")
    known = join_spread(lines, ids, ["a", "b"], "n", "line").where("line is not null")
    place, stretch = Window.partitionBy("row").orderBy("j"), Window.partitionBy("row", "seg")
    found = (
        known.withColumn("seg", F.col("j") - F.row_number().over(place))
        .withColumn("at", F.sum("words").over(stretch.orderBy("j")) - F.col("words"))
        .withColumn("length", F.sum("words").over(stretch))
        .select("doc", "row", "pos", "j", "line", "words", "seg", "at", "length")
    )
    found = materialise(found.where(F.col("length") >= least), "stretches")
    discard(lines, ids)
    return found


def double(level: DataFrame, lines: int, whole: bool) -> DataFrame:
    """From the ranks of runs of `lines` lines (row, seg, j, rank, ...) those of runs of twice as many.

    Pairs of ranks `lines` lines apart are range-sorted, and a pair's place is the new rank; equal runs tie. Unless
    whole, runs that are cut off by their stretch's end, or that no other run equals, drop out; else a cut-off run
    sorts before its continuations. Repeated rows of (row, seg, j) must not occur. An empty table gives no rows.
    """
    others = [c for c in level.columns if c != "rank"]
    ahead = F.max("rank").over(Window.partitionBy("row", "seg").orderBy("j").rangeBetween(lines, lines))
    pairs = level.withColumn("next", F.coalesce(ahead, F.lit(-1).cast("long")))
    pairs = materialise(pairs if whole else pairs.where("next >= 0"), "pairs")
    names = pairs.groupBy("rank", "next").agg(F.count("*").alias("n"))
    names = names if whole else names.where("n > 1")
    sorted_names = materialise(names.repartitionByRange("rank", "next").sortWithinPartitions("rank", "next").withColumn("place", F.monotonically_increasing_id()), "names")
    ranked = materialise(join_spread(pairs, sorted_names, ["rank", "next"], "n", "place").where("place is not null").select(*others, F.col("place").alias("rank")), "ranks")
    discard(pairs, sorted_names)
    return ranked


def both_ways(lines: DataFrame, min_words: int) -> DataFrame:
    """lines (row, doc, seg, j, line, words, at, length) and the same read backwards: doc, row, seg (own numbers for
    either direction), j (ascending in reading order), back, line, need (lines of the shortest part of min_words words
    from here on; null if the stretch ends before), left (lines to the stretch's end), deep (largest need of the stretch)."""
    each = lines.select("doc", "row", (2 * F.col("seg")).alias("seg"), "j", F.lit(0).alias("back"), "line", "at", "length")
    turned = lines.select("doc", "row", (2 * F.col("seg") + 1).alias("seg"), (-F.col("j")).alias("j"), F.lit(1).alias("back"), "line", (F.col("length") - F.col("at") - F.col("words")).alias("at"), "length")
    stretch = Window.partitionBy("row", "seg")
    need = F.when(F.col("length") - F.col("at") >= min_words, F.count("*").over(stretch.orderBy("at").rangeBetween(Window.currentRow, min_words - 1)))
    left = F.count("*").over(stretch) - F.row_number().over(stretch.orderBy("at")) + 1
    found = each.unionByName(turned).select("doc", "row", "seg", "j", "back", "line", need.alias("need"), left.alias("left"))
    return found.withColumn("deep", F.max("need").over(stretch))


def suffix_array(suffixes: DataFrame, rounds: int) -> DataFrame:
    """The suffixes (doc, row, seg, j, back, line, need, left, deep), range-sorted by their first 2^rounds lines, then by
    doc (nulls first), row and j, with r0 ... r<rounds> (their ranks by 1, 2, 4 ... lines; equal runs tie, and one that
    ends sorts before its continuations) and place, which rises along the array and holds the range's number in its upper
    bits. A stretch is ranked by no more lines than it takes to reach its deep; further ranks are null.

    (row, seg, j) must not repeat. An empty table gives no rows.
    """
    level, settled = suffixes.withColumn("rank", F.col("line")).withColumn("r0", F.col("line")), []
    for k in range(1, rounds + 1):
        settled.append(level.where(F.col("deep") <= 1 << (k - 1)))
        level = double(level.where(F.col("deep") > 1 << (k - 1)), 1 << (k - 1), whole=True).withColumn(f"r{k}", F.col("rank"))
    for some in reversed(settled):
        level = level.unionByName(some, allowMissingColumns=True)
    order = ("back", *(F.col(f"r{k}").asc_nulls_first() for k in range(rounds + 1)), F.col("doc").asc_nulls_first(), "row", "j")
    sorted_ = level.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return materialise(sorted_.drop("rank", "line", "deep"), "suffix-array")


def neighbours(array: DataFrame) -> DataFrame:
    """array with before: the suffix in front of each as (back, row, seg, j, left, r0 ...), null for the first.

    A range's first suffix has its neighbour in the range before; there are as many of these as ranges.
    """
    ranks = [c for c in array.columns if c[0] == "r" and c[1:].isdigit()]
    own = F.struct("back", "row", "seg", "j", "left", *ranks)
    parts = array.withColumn("part", F.shiftright("place", 33))
    ends = parts.groupBy("part").agg(F.max_by(own, "place").alias("end")).select("part", F.lag("end").over(Window.orderBy("part")).alias("end"))
    return parts.join(F.broadcast(ends), "part").withColumn("before", F.coalesce(F.lag(own).over(Window.partitionBy("part").orderBy("place")), "end")).drop("end")


def common_prefixes(array: DataFrame, some: DataFrame, rounds: int, whole: bool = True) -> DataFrame:
    """neighbours(some), rows of the suffix array, with lcp: lines that a suffix and the one in front of it among them have
    in common, counted up to 2^rounds; 0 for the first and where the directions differ.

    The last of their own ranks that agrees gives the power of two below; the ranks that far behind both then decide about
    half of it, and so on. Unless whole, that is done only where it decides whether lcp reaches need; elsewhere lcp is
    the power of two.
    """
    pairs = neighbours(some).withColumn("lcp", F.lit(0))
    for k in range(rounds + 1):
        pairs = pairs.withColumn("lcp", F.when((F.col(f"before.r{k}") == F.col(f"r{k}")) & (F.col("before.back") == F.col("back")), F.lit(1 << k)).otherwise(F.col("lcp")))
    pairs = materialise(pairs, "pairs")
    doubt = (F.col("lcp") > 0) & (F.col("lcp") < 1 << rounds)
    doubt = doubt if whole else doubt & (F.col("need") > F.col("lcp")) & (F.col("need") < 2 * F.col("lcp"))
    undecided = pairs.where(doubt).select("place", "row", "seg", "j", F.col("before.row").alias("row0"), F.col("before.seg").alias("seg0"), F.col("before.j").alias("j0"), F.col("lcp").alias("top"), F.col("lcp").alias("reach"))
    for k in reversed(range(rounds)):
        at = lambda s, k=k: array.select(F.col("row").alias(f"row{s}_"), F.col("seg").alias(f"seg{s}_"), F.col("j").alias(f"j{s}_"), F.col(f"r{k}").alias(f"rank{s}"))
        for s in ("", "0"):
            undecided = undecided.join(at(s), (F.col(f"row{s}") == F.col(f"row{s}_")) & (F.col(f"seg{s}") == F.col(f"seg{s}_")) & (F.col(f"j{s}") + F.col("reach") == F.col(f"j{s}_")), "left").drop(f"row{s}_", f"seg{s}_", f"j{s}_")
        further = F.coalesce((F.col("rank") == F.col("rank0")) & (F.lit(1 << k) < F.col("top")), F.lit(False))
        undecided = undecided.withColumn("reach", F.col("reach") + F.when(further, 1 << k).otherwise(0)).drop("rank", "rank0")
    found = pairs.join(undecided.select("place", "reach"), "place", "left")
    return found.withColumn("lcp", F.least(F.coalesce("reach", "lcp"), "left", F.coalesce("before.left", F.lit(0)))).drop("reach")


def repeated_parts(lines: DataFrame, min_words: int) -> DataFrame:
    """(row, s, n): the shortest parts that are later copies, from the intervals of the suffix array of lines (a written
    table of repeated lines)."""
    suffixes = materialise(both_ways(lines, min_words), "suffixes")
    longest = suffixes.agg(F.max("need")).first()[0] or 1
    rounds = (int(longest) - 1).bit_length()
    array = suffix_array(suffixes, rounds)
    # Suffixes that are too short for a part sort apart from all that are not.
    parts = materialise(common_prefixes(array, array.where("need is not null"), rounds, whole=False).select("doc", "back", "row", "seg", "j", "need", "place", "part", (F.col("lcp") < F.col("need")).alias("opens")), "intervals")
    before = parts.groupBy("part").agg(F.count_if("opens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    opened = F.count_if("opens").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    numbered_ = parts.join(F.broadcast(before), "part").withColumn("interval", F.col("before") + opened)  # one row a range
    # The line a part starts at: read backwards, its last line comes first.
    starts = numbered_.select("interval", "row", "seg", "j", "doc", F.when(F.col("back") == 0, F.col("j")).otherwise(-F.col("j") - F.col("need") + 1).alias("s"), F.col("need").alias("n"))
    earliest = starts.groupBy("interval").agg(F.min(F.struct(F.col("doc").isNotNull(), "doc", "row", "s", "seg", "j")).alias("e")).select("e.row", "e.seg", "e.j")
    copies = materialise(starts.join(earliest, ["row", "seg", "j"], "left_anti").select("row", "s", "n"), "copies")
    discard(suffixes, array, parts)
    return copies


def later_copies(rows: DataFrame, min_words: int = 50) -> DataFrame:
    """(row, runs, gone, gone_words): by row of rows (row, doc, text) the runs (low, high; places in the text) of lines
    that lie in a later copy of a repeated run of at least min_words words, with their lines and words.

    Earlier means by doc (nulls first), row and line. Overlapping copies form one run.
    """
    lines = repeated_lines(rows, min_words)
    copies = repeated_parts(lines, min_words)
    reach = copies.groupBy("row", "s").agg(F.max(F.col("s") + F.col("n") - 1).alias("end"))
    place = Window.partitionBy("row").orderBy("j")
    covered = lines.select("row", "j", "pos", "words").join(reach.withColumnRenamed("s", "j"), ["row", "j"], "left").withColumn("reach", F.max("end").over(place)).where("reach >= j")
    runs = covered.withColumn("run", F.col("j") - F.row_number().over(place)).groupBy("row", "run").agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.count("*").alias("n"), F.sum("words").alias("w"))
    gone = materialise(runs.groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("runs"), F.sum("n").alias("gone"), F.sum("w").alias("gone_words")), "runs")
    discard(lines, copies)
    return gone


def drop_repeated_runs(docs: DataFrame, min_words: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with later copies of repeated line runs cut from the text, and lines_removed (which replaces a column of that
    name).

    A run of consecutive lines (those without words aside) of at least min_words words that occurs earlier, by key, row
    and line, loses its lines; the earliest copy stays, and so do lines without words. Runs may overlap, so a line that
    repeats on end stays once. Null texts stay null and empty ones empty; a text of copies only becomes empty; very long
    texts are cut like others; rows of equal or null keys, and repeated rows, are documents of their own (null keys
    first, then in the order of the input). Other columns stay as they are, whatever their names. An empty table gives
    no rows.
    """
    rows, names = numbered(docs)
    doc, body = names[docs.columns.index(key)], names[docs.columns.index(text)]
    gone = later_copies(rows.select("row", F.col(doc).alias("doc"), F.col(body).cast("string").alias("text")), min_words)
    marked = rows.join(gone, "row", "left")
    in_run = lambda i: F.exists("runs", lambda r: (i >= r["low"]) & (i <= r["high"]))
    kept = F.array_join(F.filter(F.split(F.col(body), "\n", -1), lambda line, i: ~in_run(i) | ~F.regexp_like(line, F.lit(WORD))), "\n")
    out = [(F.when(F.col("runs").isNull(), F.col(c)).otherwise(kept) if c == body else F.col(c)).alias(old) for c, old in zip(names, docs.columns) if old != "lines_removed"]
    return marked.select(*out, F.coalesce("gone", F.lit(0)).cast("long").alias("lines_removed"))
