"""The queries that apply the corpus operators to the tables, and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, save


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    verdicts, _ = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return verdicts.drop("_k1", "_k2")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keep: not judged toxic, and not of clearly low quality.

    documents have no url: source stands for the host and lang, as the only finer grouping at hand, for the path.
    """
    from .quality import classify

    found = classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    return found.select("*", ((F.col("toxic_score") < 0.5) & (F.col("quality_score") >= 0.2)).alias("keep"))


def op2_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, k=4)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneserney import fit, score_texts
    from .langid import fold

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_texts(docs, fit(docs.where(fold("doc_id", 5) != 1)), ["doc_id"])
    return found.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import deduplicate_substrings

    out = deduplicate_substrings(read_table(spark, sf_dir, "documents").select("doc_id", "text"), length=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fold, identify, train

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(fold("doc_id", 4) != 2))
    found = identify(docs, model, ["doc_id"])
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_folder, read_archives, write_archives

    manifest = save(write_archives(read_table(spark, sf_dir, "pages"), archive_folder(spark)), "manifest")
    files = manifest.repartition(max(1, manifest.count()), "path")
    return read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


#: (action, host, path)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import filter_urls

    return filter_urls(read_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "action string, host string, path string"))


OP8_SQL = """
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(action, rule_host, rule_path) AS (VALUES """ + ", ".join(str(r) for r in URL_RULES) + """),
judged AS (
  SELECT p.*, r.rule_host || r.rule_path AS rule, r.action,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host) DESC NULLS LAST, length(rule_path) DESC) AS n
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM judged WHERE n = 1
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")).drop("_k1", "_k2")


QUERIES = {f.__name__: f for f in (op1_quality, op2_simhash_near_duplicates, op3_lm_score, op4_substring_dedup, op5_language_id, op6_warc_archive, op7_nearest_neighbours, op8_url_filter, op9_packing, op10_benchmark_decontamination)}
ORACLES: dict[str, str] = {"op8_url_filter": OP8_SQL}
