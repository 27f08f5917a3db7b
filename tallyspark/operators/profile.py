"""Looking into a store: counts, fields, values, single documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.decode import ENCODINGS, decoded
from ..functions.text import flat
from ..sources.store import Store


def stored_fields(store: Store) -> DataFrame:
    """field, docs (a repeated field counts once a document), also_indexed."""
    counts = store.live().select(F.explode(F.map_keys("fields")).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("docs"))
    return counts.join(store.indexed_fields().withColumn("also_indexed", F.lit(True)), "field", "left").fillna(False, ["also_indexed"])


def indexed_only(store: Store) -> DataFrame:
    """Fields that are indexed and stored by no document."""
    return store.indexed_fields().join(stored_fields(store), "field", "left_anti")


def info(store: Store) -> dict[str, DataFrame]:
    return {"counts": store.counts(), "files": store.files(), "stored": stored_fields(store), "indexed_only": indexed_only(store)}


def dump(store: Store, take: int = 5, doc: int | None = None, where: str | None = None, value: str | None = None) -> DataFrame:
    """doc, field, value of the first live documents, in scan order, that match; fields by name."""
    rows = store.live()
    if doc is not None:
        rows = rows.where(F.col("doc_id") == doc)
    if where is not None:
        rows = rows.where(F.map_contains_key("fields", F.lit(where)))
        if value is not None:
            rows = rows.where(F.exists(F.col("fields")[where], lambda x: F.contains(F.lower(x), F.lit(value.lower()))))
    rows = rows.orderBy("doc_id").limit(take).select("doc_id", F.explode("fields").alias("field", "values"))
    return rows.select(F.col("doc_id").alias("doc"), "field", F.posexplode("values").alias("n", "value")).select("doc", "field", "n", flat(F.col("value"), 300).alias("value"))


def value_counts(store: Store, field: str) -> DataFrame:
    return store.live().select(F.explode(F.col("fields")[field]).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("count"))


def values(store: Store, field: str, take: int = 20) -> DataFrame:
    """count, value, decoded of a field's commonest values."""
    top = value_counts(store, field).orderBy(F.desc("count"), "value").limit(take)
    return top.select("count", flat(F.col("value"), 40).alias("value"), decoded(F.col("value"), F.lit(ENCODINGS.get(field, "text"))).alias("decoded"))


def value_totals(store: Store, field: str) -> DataFrame:
    """distinct_values, total_values; no row if no live document has the field."""
    return value_counts(store, field).agg(F.count(F.lit(1)).alias("distinct_values"), F.sum("count").alias("total_values")).where("distinct_values > 0")


def listing(registered: DataFrame, counted: DataFrame) -> DataFrame:
    """Registrations with the live and deleted counts of their stores (path, live, deleted); null where unreadable."""
    return registered.join(counted, "path", "left").select("name", "path", "id", "read_only", "live", "deleted")
