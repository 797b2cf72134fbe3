"""The queries opN_<name> over the shared test tables, and their expected-result SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import conversations, debruijn, decontaminate, importance, kd_shards, licences, metric_join, mixing, quality, simhash, token_files, url_model, warc_bundles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EXPECTED: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            EXPECTED[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_token_files")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.read_documents(token_files.written(table(spark, folder, "documents"), tokenizer_path()))


@query("op2_mix_sources")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.positions(table(spark, folder, "documents").select("doc_id", "source"))


SHARDS = 40


@query("op3_kd_shards")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    placed = kd_shards.shard(table(spark, folder, "documents"), SHARDS, ["n_chars", "doc_id", "source", "lang"])
    return placed.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query("op4_url_filter")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_model.judge(pages, URL_RULES, url_model.train(pages)).select("page_id", "host", "path", "rule", "verdict", "score")


@query("op5_substring_dedup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return debruijn.digests(table(spark, folder, "documents"))


@query("op6_simhash")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.classes(table(spark, folder, "documents"))
    return found.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query("op7_decontaminate")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op8_licences")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return licences.scan(docs, licences.train(docs)).select("doc_id", F.array_join("licences", ",").alias("licences"), "notices")


@query("op9_warc_bundles")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = warc_bundles.read(warc_bundles.written(table(spark, folder, "pages")))
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


QUALITY_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) x WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM pos),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM win WHERE n > 1) x GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_lines,
             CAST(coalesce(lines.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN lines ON lines.doc_id = w.doc_id LEFT JOIN rep ON rep.doc_id = w.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 5 * n_symbols > n_words OR 10 * n_dup_lines > 4 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept FROM m
"""


@query("op10_quality", QUALITY_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judge(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", *names)


#: CRC-32 by its definition: a table of 256 remainders, then one step a byte.
RESAMPLE_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
               lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
dw AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) x GROUP BY r, w),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) x GROUP BY w),
hexed AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw) x),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(CAST(length(h) // 2 AS BIGINT)),
             lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM hexed, crc),
s AS (SELECT bucket, sum(n) AS n FROM dw JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM bw JOIN hashed USING (w) GROUP BY bucket),
g AS (SELECT b.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
             / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain
      FROM range(10000) b(bucket) LEFT JOIN s ON s.bucket = b.bucket LEFT JOIN t ON t.bucket = b.bucket),
m AS (SELECT r, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM dw JOIN hashed USING (w) JOIN g USING (bucket) GROUP BY r),
scored AS (SELECT d.r, doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
             (CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN m ON m.r = d.r),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM placed) * 10 // 100 THEN place END AS rank
FROM scored LEFT JOIN placed ON placed.r = scored.r
"""


@query("op11_importance_resample", RESAMPLE_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    drawn = importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select(F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank")


@query("op12_jaccard_join")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = metric_join.join(table(spark, folder, "documents"))
    return found.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@query("op13_repair_conversations")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    said = table(spark, folder, "conversations")
    return conversations.repair_all(said, conversations.damage(said)).withColumnRenamed("conv", "conv_id")
