"""One registered query for each corpus operator: production parameters, whole tables, digests of the results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbispan.llm import decontam, lines, order_minhash, packing, pii, pq, quality, resample, secrets, shards, simhash, warc, whitening
from orbispan.llm.common import read_table


def op1_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), shingle=5, similarity=0.8)
    return found.select(F.col("id").alias("doc_id"), "item_id", F.round("similarity", 6).alias("similarity"), "first_word", "n_words")


#: Replaces the key that a deployment passes in; surrogates depend on it alone.
DEMO_KEY = b"orbispan-demo-key"


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.with_surrogates(read_table(spark, sf_dir, "documents"), DEMO_KEY, count_col="n_entities", kinds_col="kinds")
    return done.select("doc_id", "n_entities", "kinds", "text")


def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


RECORDS_PER_FILE = 1024


def op4_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as WARC files against a replica of them in which every 97th record has rotted: its first byte became '~'."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    files = max(1, -(-pages.count() // RECORDS_PER_FILE))
    rot = (F.pmod("page_id", F.lit(97)) == 13) & (F.length("html") > 0)
    copy = pages.withColumn("html", F.when(rot, F.concat(F.lit("~"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))
    name = F.concat_ws(" ", F.coalesce(F.col("id").cast("string"), F.lit("-")), "uri")
    dealt = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") % files).cast("int")
    found = warc.audit(*[warc.laid_out(warc.warc_records(x), files, dealt) for x in (pages, copy)])
    return found.select(F.col("id").alias("page_id"), "file", "ordinal", "offset", "length", "kind")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"))
    return secrets.digest_columns(found).withColumnRenamed("id", "doc_id")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), size=2048).withColumnRenamed("id", "doc_id")


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.drop_recurring_lines(read_table(spark, sf_dir, "documents"), count_col="n_dropped")
    text = F.coalesce("text", F.lit(""))
    return done.select("doc_id", "n_dropped", F.octet_length(text).cast("long").alias("bytes_left"), F.crc32(text.cast("binary")).alias("text_crc32"))


def op8_pq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pq.near_vectors(read_table(spark, sf_dir, "embeddings"), cosine=0.95)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op9_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.byte_shards(read_table(spark, sf_dir, "documents"), shards=24)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_components(read_table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return groups.select(F.col("id").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op11_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.edited_pairs(read_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        order_minhash.hex_text("fingerprint").alias("fingerprint"), order_minhash.hex_text("edited_fingerprint").alias("edited_fingerprint"),
        order_minhash.likeness("fingerprint", "edited_fingerprint").alias("near_edited"), order_minhash.likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )


def op12_bit_sliced_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = resample.importance_weights(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), buckets=10_000, max_words=1)
    return resample.drawn(weighted, percent=10, min_words=20, seed=2024).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op13_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(read_table(spark, sf_dir, "embeddings"), components=8)
    return found.withColumn("deviation", F.col("deviation").try_cast("long")).withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_decontamination": op1_simhash_decontamination,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_pu_quality": op3_pu_quality,
    "op4_merkle_audit": op4_merkle_audit,
    "op5_secret_scan": op5_secret_scan,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_line_templates": op7_line_templates,
    "op8_pq_near_dedup": op8_pq_near_dedup,
    "op9_byte_shards": op9_byte_shards,
    "op10_simhash_bktree": op10_simhash_bktree,
    "op11_order_minhash": op11_order_minhash,
    "op12_bit_sliced_resampling": op12_bit_sliced_resampling,
    "op13_cholesky_whitening": op13_cholesky_whitening,
}
SQL: dict[str, str] = {
    "op4_merkle_audit": """
WITH n AS (SELECT greatest(1, CAST(ceil(count(*) / 1024.0) AS BIGINT)) AS files FROM pages),
sized AS (
  SELECT page_id, html, CAST(('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), '-') || ' ' || coalesce(url, '-')), 1, 8))::BIGINT % files AS INTEGER) AS file,
    strlen('WARC/1.1') + 2 + strlen('WARC-Type: resource') + 2 + strlen('WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '-') || '>') + 2
    + strlen('WARC-Target-URI: ' || coalesce(url, '-')) + 2 + strlen('WARC-Block-Digest: sha256:') + 64 + 2
    + strlen('Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR)) + 4 + strlen(coalesce(html, '')) + 4 AS length
  FROM pages, n),
placed AS (
  SELECT *, row_number() OVER w - 1 AS ordinal, coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset"
  FROM sized WINDOW w AS (PARTITION BY file ORDER BY page_id NULLS FIRST))
SELECT page_id, file, CAST(ordinal AS INTEGER) AS ordinal, CAST("offset" AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length, 'corrupt' AS kind
FROM placed WHERE ((page_id % 97) + 97) % 97 = 13 AND length(html) > 0 AND html[1] <> '~'
""",
    # the checksum of each distinct word runs over its UTF-8 bytes by halves, low half first, with the table of 16 steps
    "op12_bit_sliced_resampling": """
WITH RECURSIVE step(i, k, c) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(16) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 4),
steps AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 4),
d_words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents),
b_words AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
known AS (SELECT DISTINCT w FROM (SELECT w FROM d_words UNION ALL SELECT w FROM b_words)),
halves AS (SELECT w, hex(encode(w)) AS x FROM known),
buckets AS (
  SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(strpos('0123456789ABCDEF', x[i + 1 + CAST(i % 2 = 0 AS INT) - CAST(i % 2 = 1 AS INT)]) - 1 AS BIGINT) FOR i IN range(length(x))]),
    lambda c, h: xor(c >> 4, t[(xor(c, h) & 15) + 1])), 4294967295) % 10000 AS b FROM halves, steps),
s AS (SELECT b, count(*) AS s FROM d_words JOIN buckets USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM b_words JOIN buckets USING (w) GROUP BY b),
gains AS (
  SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)))) AS BIGINT) AS g
  FROM s LEFT JOIN t USING (b)),
sums AS (SELECT doc_id, count(*) AS n, sum(g) AS g FROM d_words JOIN buckets USING (w) JOIN gains USING (b) GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(CAST(g // n AS BIGINT) - CAST(g % n < 0 AS BIGINT), 0) AS weight,
    coalesce(CAST(g // n AS BIGINT) - CAST(g % n < 0 AS BIGINT), 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM documents LEFT JOIN sums USING (doc_id)),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN r <= n * 10 // 100 THEN CAST(r AS BIGINT) END AS rank
FROM scored LEFT JOIN ranks USING (doc_id)
""",
}
