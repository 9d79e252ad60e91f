"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, langid, linededup, mixing, ngram_join, packing, permutation_index, ppm, token_index, toxicity, variants, vector_dedup, warc


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.curriculum_mix(table(spark, sf_dir, "documents"))
    return mixing.by_position(mixed).drop("copies")


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS o
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source
), limited AS (
  SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size::DOUBLE * 3 AS lim, [0.5, 0, -0.5][((rank - 1) % 3 + 1)::INT]::DOUBLE AS slope FROM sizes
), levels AS (
  SELECT *, row_number() OVER (ORDER BY lim / weight, rank) AS turn,
         (sum(source_size) OVER ()::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM limited
), targets AS (
  SELECT source, source_size, slope, least(lim, weight * (SELECT level FROM levels WHERE lim >= weight * level ORDER BY turn LIMIT 1)) AS target FROM levels
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.slope, floor(t.target)::BIGINT AS goal,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.o, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, greatest(0, least(size, goal - place)) + greatest(0, least(size, goal - place - source_size)) + greatest(0, least(size, goal - place - 2 * source_size)) AS taken FROM placed
)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
       CASE WHEN size > 0 AND goal > place THEN CASE WHEN slope = 0 THEN place::DOUBLE / goal
            ELSE 2 * (place::DOUBLE / goal) / (1 + slope + sqrt((1 + slope) * (1 + slope) - 4 * slope * (place::DOUBLE / goal))) END END AS position
FROM taken
"""


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index.token_index(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), window=2048, end_id=1, with_ids=False)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.round_trip(table(spark, sf_dir, "pages"), with_payload=False)
    page = lambda c: F.regexp_extract(c, r"^<urn:capture:(-?\d*):", 1)
    return captures.select(
        F.col("metadata.fields")["pageId"].cast("long").alias("page_id"),
        # A revisit holds no payload; its length is what the metadata record says.
        F.coalesce("response.payload_bytes", F.col("metadata.fields")["payloadLength"].cast("long")).alias("payload_bytes"),
        F.coalesce("response.payload_digest", "response.header_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.nullif(page("response.refers_to"), F.lit("")).cast("long").alias("refers_to"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    found = toxicity.score_documents(docs, model, threshold=0.7)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_repeated_runs(table(spark, sf_dir, "documents"), min_words=50).select("doc_id", "text", "lines_removed")


OP9_SQL = r"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), counted AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM cut
), lines AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS j, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM counted WHERE words > 0
), parts AS (
  SELECT a.doc_id, a.j AS s, min(b.j) AS e FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.j >= a.j AND b.upto - a.upto + a.words >= 50 GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.j) AS s, b.j AS e FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.j >= a.j AND b.upto - a.upto + a.words >= 50 GROUP BY b.doc_id, b.j
), contents AS (
  SELECT p.doc_id, p.s, p.e, md5(string_agg(l.line, chr(10) ORDER BY l.j)) AS content FROM parts p JOIN lines l ON l.doc_id = p.doc_id AND l.j BETWEEN p.s AND p.e GROUP BY ALL
), later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS turn FROM contents) WHERE turn > 1
), gone AS (
  SELECT DISTINCT l.doc_id, l.pos FROM later p JOIN lines l ON l.doc_id = p.doc_id AND l.j BETWEEN p.s AND p.e
), kept AS (
  SELECT c.doc_id, string_agg(c.line, chr(10) ORDER BY c.pos) FILTER (WHERE g.pos IS NULL) AS text, count(g.pos) AS lines_removed
  FROM cut c LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.pos = c.pos GROUP BY c.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.lines_removed, 0)::BIGINT AS lines_removed
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), "id % 50 = 0", k=5)


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), similarity=0.9)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mine_hard_negatives(rows, "id % 50 = 0", positives=5, negatives=3, least=50, most=95, scale=256)


OP11_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 100 * n.score BETWEEN 50 * p.positive_score AND 95 * p.positive_score
QUALIFY rank <= 3
"""

def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ppm.score_documents(table(spark, sf_dir, "documents"), ~langid.held_out(folds=10), order=5)
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.count_words(table(spark, sf_dir, "documents"), least_length=6, least_count=5, drop_every=199)
    return variants.spelling_variants(words, ratio=5)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_nearest": op2_nearest,
    "op3_mixing": op3_mixing,
    "op4_vector_dedup": op4_vector_dedup,
    "op5_token_output": op5_token_output,
    "op6_packing": op6_packing,
    "op7_warc": op7_warc,
    "op8_toxicity": op8_toxicity,
    "op9_line_dedup": op9_line_dedup,
    "op10_ngram_join": op10_ngram_join,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_lm_scoring": op12_lm_scoring,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES = {"op3_mixing": OP3_SQL, "op9_line_dedup": OP9_SQL, "op11_hard_negatives": OP11_SQL}
