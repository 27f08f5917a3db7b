"""The corpus pipeline: language, near duplicates, repeated passages, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. Stages but the last return the columns of documents; a stage works on all that its predecessor kept.
Null and empty texts are rejected by the first stage, as they have no language. Rows that repeat one doc_id and text
are near duplicates of each other, and one stays. Documents may have further columns of any name, which pass through.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import made_in, read_table, release, row_key, save, shared_path
from tallyspark.llm.decontaminate import decontaminate
from tallyspark.llm.langid import UNDETERMINED, identify, train
from tallyspark.llm.packing import pack
from tallyspark.llm.queries import tokenizer
from tallyspark.llm.similar import similar_groups
from tallyspark.llm.substring import deduplicate_substrings

#: A text whose best label has a smaller share of its words' posterior mass has no language of its own.
LEAST_SCORE = 0.35
#: Words of a passage that must not repeat.
PASSAGE = 50
#: The columns that stages know; the others are renamed for as long as a stage adds columns of its own.
KNOWN = {"doc_id", "text", "lang", "n_chars"}


#: Shared tables of the stage that was called last on its own: done with when the next one is called, since its rows are
#: then written. run() keeps those of its stages apart, so that a run and its lazy result never lose theirs to another.
_last: list = []


def passing(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with the documents' further columns out of the way of its own."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in KNOWN else f"_c{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).select(names).toDF(*docs.columns)

    return run_stage


def alone(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage as STAGES lists it: it deletes the shared tables of the stage called before."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(_last)
        with made_in(_last):
            return stage(spark, docs, sf_dir)

    return run_stage


@passing
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: those with no letter, and mixtures that no label leads."""
    found = identify(docs, train(docs), docs.columns)
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


@passing
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more over five-word shingles, keep that with the least doc_id."""
    # a null id comes last; rows that repeat id and text have one name
    name = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", F.xxhash64("doc_id", "text").alias("k"))
    groups = save(similar_groups(docs.select(name.alias("name"), "text"), id_col="name").select("doc_id", "group_id"), "groups")
    kept = groups.where(F.col("doc_id") == F.col("group_id")).groupBy(F.col("doc_id.doc_id").alias("id"), F.col("doc_id.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    same = F.xxhash64("doc_id", "text").eqNullSafe(F.col("k")) & F.col("doc_id").eqNullSafe(F.col("id"))
    out = docs.join(kept.hint("shuffle_hash"), same, "left_semi")
    return out if kept.where("n > 1").isEmpty() else out.dropDuplicates(["doc_id", "text"])


@passing
def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words or more that stand elsewhere too; a document left without a word goes."""
    out = deduplicate_substrings(docs, length=PASSAGE)
    cut = F.col("n_removed") > 0
    out = out.where(~cut | (F.col("kept") != ""))
    out = out.withColumn("text", F.when(cut, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


@passing
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten consecutive words of a benchmark item (all its words, if it has fewer)."""
    verdicts, _ = decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    clean = verdicts.where(~F.col("contaminated")).select("_k1", "_k2").distinct()
    return docs.select("*", *row_key("doc_id", "text")).join(clean.hint("shuffle_hash"), ["_k1", "_k2"], "left_semi").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequence and offset."""
    return pack(docs, tokenizer("word_bpe_49k.json")).drop("_k1", "_k2")


_STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [(name, alone(stage)) for name, stage in _STAGES]

#: SQL can state neither the learned language model nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in _STAGES[:-1]:
        with made_in([]) as made:
            out = stage(spark, docs, sf_dir)
        path = shared_path(spark, name, keep=True)
        out.write.parquet(path)
        release(made)
        docs = spark.read.schema(_nullable(out.schema)).parquet(path)
    return _STAGES[-1][1](spark, docs, sf_dir)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
