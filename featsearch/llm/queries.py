"""The registered queries of the operators, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featsearch.llm import (
    alignment, bpe, chat, exact_dedup, html_text, jaccard, mixing, ngram_model, quality, secrets, substring_dedup, toxicity, whitening,
)
from featsearch.llm.common import table


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.plan(table(spark, sf_dir, "documents"))
    return mixed.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


OP2_SQL = f"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM sized GROUP BY source
), capped AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         CAST(source_size * 2 AS DOUBLE) AS cap
  FROM per
), leveled AS (
  SELECT *, cap / w AS ratio,
         (CAST((SELECT sum(source_size) FROM per) AS DOUBLE) * 1.5
            - (sum(cap) OVER (ORDER BY cap / w, rank ROWS UNBOUNDED PRECEDING) - cap))
         / ((SELECT sum(w) FROM capped) - (sum(w) OVER (ORDER BY cap / w, rank ROWS UNBOUNDED PRECEDING) - w)) AS level
  FROM capped
), first AS (
  SELECT ratio AS r, level AS l FROM leveled WHERE ratio > level ORDER BY ratio, rank LIMIT 1
), goal AS (
  SELECT source, source_size,
         CASE WHEN (SELECT l FROM first) IS NULL OR ratio <= (SELECT l FROM first) THEN cap
              ELSE w * (SELECT l FROM first) END AS target,
         CAST(('0x' || substr(md5('{mixing.SEED}:' || coalesce('s' || source, 'null')), 1, 8)) AS BIGINT)
           / 4294967296.0::DOUBLE AS u
  FROM leveled
), numbered AS (
  SELECT s.*, g.source_size, g.target, g.u,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS rate,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS LAST) AS nth
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       CAST(floor(nth * rate + u) - floor((nth - 1) * rate + u) AS BIGINT) * size AS taken
FROM numbered
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes(F.col("failed"), "base")).alias("base_failed"),
        quality.passes(F.col("failed"), "v1").alias("kept"),
        "failed", "n_lines", "n_letters", "n_upper",
    )


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), grams AS (
  SELECT r, i, list_slice(ws, i, i + 4) AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(0, 5)) AS k) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS BIGINT) AS n_letters,
         CAST(length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS BIGINT) AS n_upper
  FROM d LEFT JOIN covered c USING (r)
), f AS (
  SELECT *, CAST(
      CASE WHEN n_words < 10 THEN 1 ELSE 0 END
    + CASE WHEN n_repeat_words * 100 > n_words * 20 THEN 2 ELSE 0 END
    + CASE WHEN n_symbols * 100 > n_words * 30 THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND n_dup_lines * 100 > n_lines * 40 THEN 8 ELSE 0 END
    + CASE WHEN n_words >= 10 AND n_upper * 100 > n_letters * 50 THEN 16 ELSE 0 END
    + CASE WHEN n_words >= 10 AND (word_chars > n_words * 40 OR word_chars < n_words * 2) THEN 32 ELSE 0 END
    AS BIGINT) AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed, n_lines, n_letters, n_upper
FROM f
"""


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.classes(table(spark, sf_dir, "documents"), keep="largest")
    return rows.withColumnRenamed("id", "doc_id")


OP5_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id,
       count(*) OVER (PARTITION BY text) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY text) AS kept,
       sha256(text) AS text_sha256
FROM t
"""

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def tokenized(spark: SparkSession, docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """Digests of the ids of every text and of the bytes they decode to."""
    import public_tokenizers

    path, pattern = public_tokenizers.path(name), public_tokenizers.PATTERN
    rows = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    return rows.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(spark, table(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jaccard.classes(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.col("n_shingles").cast("long"), "component_id")


def _joined(spans, kinds=None):
    if kinds:
        spans = F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(table(spark, sf_dir, "documents"))
    spans = F.col("spans")

    def found(kind):
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")

    return rows.select(
        F.col("id").alias("doc_id"), *[found(k).alias(f"n_{k}") for k in secrets.KINDS[:3]],
        F.sha2(_joined(spans, secrets.KINDS[:3]), 256).alias("base_sha256"), _joined(spans).alias("spans"),
        found("random").alias("n_random"),
    )


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_text.extract(table(spark, sf_dir, "pages"))
    return rows.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return rows.select(
        F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], turns.schema)
    return chat.read_back(chat.windows(turns.unionByName(more)))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    rows = alignment.alignment(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
    return rows.drop("pairs", "times").withColumnRenamed("id", "doc_id")


def op12_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, learn = table(spark, sf_dir, "documents"), ~ngram_model.held_out(F.col("doc_id"))
    model = ngram_model.train(docs, learn)
    rows = ngram_model.score(docs, model, learn)
    return rows.select(
        F.col("id").alias("doc_id"), (~F.col("learn")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.words.n).cast("long").alias("train_tokens"), "base_score", "score",
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumnRenamed("id", "vec_id").withColumn("deviation", F.col("deviation").cast("long"))


SPARK = {
    f.__name__: f
    for f in (
        op1_secrets, op2_mixing, op3_html_text, op4_quality, op5_exact_dedup, op6_ngram_jaccard, op7_substring_dedup, op8_toxicity,
        op9_chat, op10_bpe, op11_alignment, op12_ngrams, op13_whitening,
    )
}
ORACLE = {"op2_mixing": OP2_SQL, "op4_quality": OP4_SQL, "op5_exact_dedup": OP5_SQL}
