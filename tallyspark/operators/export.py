"""Export of items with their status records and full paths, and the text sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decode as D
from ..functions.text import csv_line, display_name, extension, item_folder_id, join_path, raw_value
from ..sources.settings import delimiter as option_delimiter
from ..sources.store import Store, first
from .hierarchy import folder_paths, folder_table

# ---- fixed values: the columns of an export ----
COLUMNS = ["FullPath", "Folder", "Name", "Extension", "IsFolder", "SizeBytes", "Modified", "Created", "IndexedDate", "ContentIndexed", "OtherFlagBits", "TermCount", "Attributes", "ItemType", "FolderId", "ItemId", "DocId", "MetaDocId"]


def raw_fields(store: Store) -> list[str]:
    """Names of the fields that live items and meta records have, sorted: the schema depends on the data."""
    docs = store.kinds().where(F.col("kind").isin("item", "meta"))
    return [r["f"] for r in docs.select(F.explode(F.map_keys("fields")).alias("f")).distinct().orderBy("f").collect()]


def joined(store: Store) -> DataFrame:
    """Items with the last meta record of the same key (case counts), if there is one, and their folder's path."""
    items = store.of_kind("item").select("doc_id", "fields", first("id").alias("item_id"))
    metas = store.kinds().where("kind = 'meta'").groupBy(first("mid").alias("item_id")).agg(F.max_by(F.struct("doc_id", "fields"), "doc_id").alias("meta"))
    paths = folder_paths(folder_table(store))
    rows = items.join(metas, "item_id", "left").withColumn("folder_id", item_folder_id(F.col("item_id"))).join(paths, "folder_id", "left")
    unknown = F.when(F.col("folder_id") == "", "").otherwise(F.concat(F.lit("<unresolved:"), "folder_id", F.lit(">")))
    return rows.withColumn("folder", F.coalesce("path", unknown)).withColumn("is_folder", D.is_folder_item(first("itemtype"), first("attrx")))


def export(store: Store, include_folders: bool = False, raw: bool = False, multi_value_sep: str = "|") -> DataFrame:
    """A row per item (files only, unless folders are asked for), decoded; with raw, the fields as they are besides."""
    rows = joined(store)
    if not include_folders:
        rows = rows.where(~F.col("is_folder"))
    meta = lambda f: F.get(F.col("meta.fields")[f], F.lit(0))
    # the fields leave their maps and become numbers in one projection; what is used often is then there once
    raws = [raw_value(F.col("fields")[f], F.col("meta.fields")[f], multi_value_sep).alias(f"raw_{f}") for f in (raw_fields(store) if raw else ())]
    numbers = {
        "_size": D.decimal_number(first("sizenr")), "_modified": D.decimal_number(first("modft")), "_created": D.decimal_number(first("createft")), "_indexed": D.decimal_number(meta("idxdt")),
        "_flags": D.hex_number(meta("idxfl")), "_terms": D.hex_number(meta("idxtrm")), "_mask": D.hex_number(first("attrx")), "_type": D.decimal_number(first("itemtype")),
    }
    rows = rows.select("folder", display_name(first("name"), F.col("item_id")).alias("_name"), "is_folder", "folder_id", "item_id", "doc_id", F.col("meta.doc_id").alias("_meta"), *(v.alias(c) for c, v in numbers.items()), *raws)
    rows = rows.withColumns({c: D.dated(F.col(c)) for c in ("_modified", "_created", "_indexed")})
    file_only = lambda x: F.when(~F.col("is_folder"), x)
    values = [
        join_path(F.col("folder"), F.col("_name")),
        F.col("folder"),
        F.col("_name"),
        F.coalesce(file_only(extension(F.col("_name"))), F.lit("")),
        F.when(F.col("is_folder"), "Y").otherwise("N"),
        file_only(F.col("_size")),
        D.timestamp_export(F.col("_modified")),
        D.timestamp_export(F.col("_created")),
        D.timestamp_export(F.col("_indexed")),
        D.content_indexed(F.col("_flags")),
        D.other_flag_bits(F.col("_flags")),
        F.col("_terms"),
        D.attribute_names(F.col("_mask")),
        F.col("_type"),
        F.col("folder_id"),
        F.col("item_id"),
        F.col("doc_id"),
        F.col("_meta"),
    ]
    return rows.select(*(v.alias(c) for v, c in zip(values, COLUMNS)), *(c for c in rows.columns if c.startswith("raw_")))


def export_counts(store: Store, include_folders: bool = False) -> DataFrame:
    """files, folders, unmatched (items without a meta record) of an export."""
    rows = joined(store)
    if not include_folders:
        rows = rows.where(~F.col("is_folder"))
    return rows.agg(F.count_if(~F.col("is_folder")).alias("files"), F.count_if("is_folder").alias("folders"), F.count_if(F.col("meta").isNull()).alias("unmatched"))


def csv_text(df: DataFrame, delimiter: str = ",") -> DataFrame:
    return df.select(csv_line([F.col(f"`{c}`") for c in df.columns], delimiter).alias("value"))


def write_csv(df: DataFrame, path: str, delimiter: str = ",", bom: bool = True, order=None) -> None:
    """The named file, with a header and CRLF line ends; rows in `order`, if given.

    Spark sorts in parallel; only the finished lines pass through the one writing task.
    """
    delimiter = option_delimiter(delimiter)
    rows = df.orderBy(*order) if order else df
    lines = csv_text(rows, delimiter)
    head = ("\ufeff" if bom else "") + delimiter.join(df.columns)
    write_file(headed(lines, head), path)


def write_file(lines: DataFrame, path: str) -> None:
    """The lines (of one partition) as the named file, in place of an older one; its folder is made."""
    sc = lines.sparkSession.sparkContext
    parts = f"{path}.{uuid.uuid4().hex}"
    lines.write.option("lineSep", "\r\n").text(parts)
    hadoop = sc._jvm.org.apache.hadoop.fs
    target, folder = hadoop.Path(path), hadoop.Path(parts)
    system = target.getFileSystem(sc._jsc.hadoopConfiguration())
    (part,) = [f.getPath() for f in system.listStatus(folder) if f.getPath().getName().startswith("part-")]
    system.delete(target, True)
    if not system.rename(part, target):
        raise OSError(f"cannot write {path}")
    system.delete(folder, True)


def headed(lines: DataFrame, head: str) -> DataFrame:
    """The lines in one partition, after a header."""

    def run(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([head])], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])

    return lines.coalesce(1).mapInArrow(run, "value string")
