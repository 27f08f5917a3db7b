"""The normalised tables of an inverted-index store, and what is read off them directly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.bytemodel import stored_value, vint
from ..functions.decode import hex_number

# ---- fixed values: the field whose presence makes a document's kind, in order of precedence ----
KIND_FIELDS = [("index", "idxv"), ("folder", "fldrid"), ("item", "id"), ("meta", "mid")]
# ---- fixed values: the files of a store that are counted ----
EXTENSIONS = [".prx", ".frq", ".fdt", ".fdx", ".nrm", ".tis", ".tii", ".fnm"]


def first(field: str) -> Column:
    """A field's first value; null if absent."""
    return F.get(F.col("fields")[field], F.lit(0))


def has(field: str) -> Column:
    return F.map_contains_key("fields", F.lit(field))


def kind(order: list[tuple[str, str]] = KIND_FIELDS) -> Column:
    out = F.lit("other")
    for name, field in reversed(order):
        out = F.when(has(field), name).otherwise(out)
    return out


def stored_text(text: Column, num: Column, binary: Column) -> Column:
    """A stored value as text, as a reader shows it: a string, else a number, else bytes in hex."""
    return F.coalesce(text, num.cast("string"), F.concat(F.lit("0x"), F.hex(binary)), F.lit(""))


def stored_string(text: Column) -> Column:
    """A stored value as the cost analysis takes it: a string; numbers and bytes are the empty text."""
    return F.coalesce(text, F.lit(""))


@dataclass
class Store:
    """docs: segment, doc (number in the segment), doc_id (in order of scan), deleted, fields (map of arrays).
    postings: segment, field, term, doc, freq, positions (null without), payloads (null without).
    field_infos: segment, field, number, is_indexed, has_norms, has_freqs, has_positions, has_payloads.
    store_files: segment, container, name, length."""

    docs: DataFrame
    postings: DataFrame | None = None
    field_infos: DataFrame | None = None
    store_files: DataFrame | None = None

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str) -> Store:
        return cls(*(spark.read.parquet(f"{path}/{name}.parquet") for name in ("docs", "postings", "field_infos", "store_files")))

    def to_parquet(self, path: str) -> None:
        for name in ("docs", "postings", "field_infos", "store_files"):
            if getattr(self, name) is not None:
                getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}.parquet")

    def live(self) -> DataFrame:
        return self.docs.where(~F.col("deleted"))

    def kinds(self) -> DataFrame:
        return self.docs.withColumn("kind", F.when(F.col("deleted"), "deleted").otherwise(kind()))

    def of_kind(self, name: str) -> DataFrame:
        """Live documents with the kind's key field."""
        return self.live().where(has(dict(KIND_FIELDS)[name]))

    def counts(self) -> DataFrame:
        """max_doc, num_docs, num_deleted, segments."""
        return self.docs.agg(F.count(F.lit(1)).alias("max_doc"), F.count_if(~F.col("deleted")).alias("num_docs"), F.count_if("deleted").alias("num_deleted"), F.array_join(F.sort_array(F.collect_set(F.col("segment").cast("string"))), "|").alias("segments"))

    def indexed_fields(self) -> DataFrame:
        return self.field_infos.where("is_indexed").select("field").distinct()

    def term_count(self) -> DataFrame:
        return self.postings.select("segment", "field", "term").distinct().agg(F.count(F.lit(1)).alias("terms"))

    def stored_bytes(self) -> DataFrame:
        """segment, doc, stored_bytes: the values' bytes, their count, and eight for the pointer; deleted documents too."""
        numbers = self.field_infos.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("field", "number"))).alias("numbers"))
        values = F.flatten(F.transform(F.map_entries("fields"), lambda e: F.transform(e["value"], lambda v: F.struct(e["key"].alias("f"), F.coalesce(F.octet_length(v), F.lit(0)).cast("bigint").alias("n")))))
        sized = self.docs.join(numbers, "segment", "left").withColumn("values", values)
        number = lambda x: F.coalesce(F.get(F.transform(F.array(x["f"]), lambda f: F.try_element_at("numbers", f)), F.lit(0)), F.lit(0))
        total = F.aggregate("values", F.lit(0).cast("bigint"), lambda a, x: a + stored_value(number(x), x["n"]))
        return sized.select("segment", "doc", (vint(F.size("values")) + total + 8).alias("stored_bytes"))

    def global_numbers(self) -> DataFrame:
        """segment, doc, number: a document's number in the whole index, its segment's base and its own."""
        sizes = self.docs.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
        before = W.orderBy("segment").rowsBetween(W.unboundedPreceding, -1)  # a row a segment
        bases = sizes.select("segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        return self.docs.join(F.broadcast(bases), "segment").select("segment", "doc", (F.col("base") + F.col("doc")).alias("number"))

    def files(self) -> DataFrame:
        """Listing in order of the name; nothing for a store that has none."""
        if self.store_files is None:
            return self.docs.sparkSession.createDataFrame([], "name string, length bigint")
        return self.store_files.select("name", "length").orderBy("name")

    def total_bytes(self) -> DataFrame:
        """store_bytes: of the counted files, each once."""
        if self.store_files is None:
            return self.docs.sparkSession.createDataFrame([(0,)], "store_bytes bigint")
        return self.bytes_by_extension().agg(F.coalesce(F.sum("actual"), F.lit(0)).cast("bigint").alias("store_bytes"))

    def bytes_by_extension(self) -> DataFrame:
        """Each file once (names that differ in case are one), by its extension, of the counted ones."""
        name = F.lower("name")
        ext = F.concat(F.lit("."), F.regexp_extract(name, r"\.([^.]+)$", 1))
        once = self.store_files.select(name.alias("name"), ext.alias("ext"), "length").where(F.col("ext").isin(EXTENSIONS))
        once = once.groupBy("name", "ext").agg(F.max("length").alias("length"))
        return once.groupBy("ext").agg(F.sum("length").cast("bigint").alias("actual"))


def list_directory(spark: SparkSession, path: str) -> DataFrame:
    """name and length of the files of a folder; contents are not read."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")


def is_folder_evidence() -> Column:
    """A folder-tree entry, an item of the folder type, or one with the directory attribute."""
    return has("fldrid") | F.coalesce(first("itemtype") == "4", F.lit(False)) | F.coalesce(hex_number(first("attrx")).bitwiseAND(16) != 0, F.lit(False))
