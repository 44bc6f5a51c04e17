"""The queries op1 to op13 over whole tables, and their SQL where there is any."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, embedding_dedup, exact_dedup, jaccard_join, line_dedup, mixing, packing, pitman_yor, quality, resampling, secrets, substring_dedup, token_files
from .common import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan_secrets(docs, secrets.train(secrets.labelled_samples(spark, docs)))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pitman_yor.score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1).withColumnRenamed("id", "doc_id")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_files.token_files(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), kind="words", end_id=1)
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"), words=3, num=9, den=10).withColumnRenamed("id", "doc_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"cairn_digests_{uuid.uuid4().hex}"
    found = exact_dedup.dedup(table(spark, sf_dir, "documents"), name)
    found = Scratch(spark, "exact-dedup").save(found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")), "found")
    exact_dedup.DigestIndex(spark, name).drop()  # this query's own index; a standing one is kept between batches
    return found


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), kind="bytes", end_id=2, capacity=1024).withColumnRenamed("id", "doc_id")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = alignment.align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return docs.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=2, buckets=10_000, percent=25, least_words=20, seed=7)
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), window=20)
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_line_dedup, op3_pitman_yor, op4_token_files, op5_embedding_dedup, op6_quality_classifier, op7_mixing, op8_jaccard_join, op9_exact_dedup, op10_packing, op11_alignment, op12_resampling, op13_substring_dedup)}

ORACLE_SQL = {
    "op2_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), twice AS (
  SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT keyed.*, twice.k IS NOT NULL AND doc_id <> first_id AS gone FROM keyed LEFT JOIN twice USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op7_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('7:' || doc_id), 1, 15) AS BIGINT) AS h FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight FROM sized GROUP BY source
), ranked AS (
  SELECT *, sum(3 * source_size) OVER w - 3 * source_size AS capped, sum(weight) OVER () - (sum(weight) OVER w - weight) AS rest, sum(source_size) OVER () AS total
  FROM src WINDOW w AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST)
), level AS (
  SELECT *, CAST(total - capped AS DOUBLE) * weight / rest <= 3 * source_size AS under FROM ranked
), open_set AS (
  SELECT CAST(sum(CASE WHEN keep THEN 0 ELSE 3 * source_size END) AS BIGINT) AS clamped, CAST(sum(CASE WHEN keep THEN weight ELSE 0 END) AS BIGINT) AS rest FROM
  (SELECT *, bool_or(under) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS keep FROM level)
), filled AS (
  SELECT l.source, l.source_size, CASE WHEN o.rest > 0 AND CAST((l.total - o.clamped) * l.weight AS DOUBLE) / o.rest <= 3 * l.source_size
    AND bool_or(l.under) OVER (ORDER BY 3.0 * l.source_size / l.weight, l.source NULLS LAST)
    THEN CAST((l.total - o.clamped) * l.weight AS DOUBLE) / o.rest ELSE CAST(3 * l.source_size AS DOUBLE) END AS target
  FROM level l, open_set o
), dealt AS (
  SELECT s.doc_id, s.size, f.source_size, f.target, CASE WHEN f.source_size > 0 THEN CAST(floor(f.target / f.source_size) AS BIGINT) ELSE 0 END AS whole,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN filled f ON s.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN target - whole * source_size > 0 AND upto - size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM dealt""",
    "op13_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM again
), word AS (
  SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM d
), kept AS (
  SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.i) AS t, count(*) AS n FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY word.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op12_resampling": r"""
WITH crc_table AS (  -- the 256 steps of CRC-32, by its rule
  SELECT [list_reduce(list_prepend(CAST(b AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) FOR b IN range(256)] AS t
), texts AS (
  SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), text FROM benchmark
), cut AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), runs AS (
  SELECT side, id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS f FROM cut
), counted AS (
  SELECT side, id, f, count(*) AS n FROM runs GROUP BY ALL
), hashed AS (
  SELECT f, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || h AS BIGINT) FOR h IN regexp_extract_all(hex(encode(f)), '..')]), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM counted), crc_table
), sums AS (
  SELECT bucket, sum(CASE WHEN side = 0 THEN n ELSE 0 END) AS s, sum(CASE WHEN side = 1 THEN n ELSE 0 END) AS t FROM counted JOIN hashed USING (f) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln(CAST((t + 1) * (ss + 10000) AS DOUBLE) / CAST((s + 1) * (tt + 10000) AS DOUBLE))) AS g FROM sums, (SELECT sum(s) AS ss, sum(t) AS tt FROM sums)
), weighed AS (
  SELECT c.id AS doc_id, sum(n) AS n_features, floor(sum(n * g) / sum(n)) AS weight FROM counted c JOIN hashed USING (f) JOIN gain USING (bucket) WHERE side = 0 GROUP BY c.id
), scored AS (
  SELECT cut.id AS doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || cut.id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM cut LEFT JOIN weighed ON cut.id = weighed.doc_id WHERE side = 0
), ranked AS (
  SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS r, sum(CASE WHEN n_words >= 20 THEN 1 ELSE 0 END) OVER () AS total FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 25 * total // 100 THEN r END AS rank FROM ranked""",
    "op9_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k""",
}
