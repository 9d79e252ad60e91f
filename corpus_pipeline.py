"""A training-data pipeline over documents, each stage one of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.llm import linededup, mixing, ngram_join, packing, toxicity
from asofkit.llm.common import WORD, discard, materialise
from asofkit.llm.queries import table, tokenizer_path


def _private(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with private column names, and those by exact name, so that names which differ by case alone do not clash."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars following the text."""
    kinds = dict(zip(docs.columns, (f.dataType for f in docs.schema.fields)))
    own, name = _private(docs)
    return own.select(*((F.length(name["text"]).cast(kinds[c]) if c == "n_chars" else F.col(name[c])).alias(c) for c in columns))


# Every stage but the last returns the columns of documents. Null, empty and very long texts, null or equal ids, repeated
# rows, ties, and other columns of any name (also those that differ from doc_id, text or source only by case) are handled
# as the operators' docstrings say; an empty table stays empty.


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from all labels; documents that score 0.7 or more go. Null and empty texts stay; repeated rows go together;
    without labels nothing goes."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs of 50 words or more leave the texts; documents of nothing else go. Null, empty
    and wordless texts stay; of repeated rows that long the first stays. A column lines_removed of documents comes back
    as the number of lines that went."""
    cut = linededup.drop_repeated_runs(docs, min_words=50)
    own, name = _private(cut)
    kept = own.where((F.col(name["lines_removed"]) == 0) | F.regexp_like(name["text"], F.lit(WORD))).toDF(*cut.columns)
    return _with_text(kept, docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the row of smallest id stays (null ids last), and of repeated rows one. Rows
    without words have no similar ones; of those with one id one stays for each text."""
    left = ngram_join.drop_similar(docs)
    own, name = _private(left)
    once = own.withColumn("same", F.xxhash64(name["text"])).dropDuplicates([name["doc_id"], "same"])
    return once.select(*(F.col(name[c]).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes, in training order; a source's last copy is cut to the words it gives. Null
    and empty texts have no words, so the mix takes none of them; a null source is a source."""
    own, name = _private(docs)
    mixed = mixing.curriculum_mix(own, key=name["doc_id"], text=name["text"], source=name["source"], keep=tuple(own.columns))
    copies = mixing.training_order(mixed)
    body = F.col("kept")[name["text"]]
    text = F.when(F.col("words") < F.col("size"), mixing.first_words(body, F.col("words"))).otherwise(body)
    return _with_text(copies.select(*((text if c == "text" else F.col("kept")[name[c]]).alias(c) for c in docs.columns)), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens; a null or empty text gives its end id alone."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), window=2048, end_id=1)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: The stages hold a learned model and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each result but the last written and read again."""
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*read)  # the stage before has been read
        read = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
