"""Registrations and settings kept as XML: reading, listing, choosing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: names in the XML ----
REGISTRY_SECTION = "section"  # of a registration; a settings section is IdxParm
FOLDERS_SECTION = "FOLDERS"


def settings(documents: DataFrame) -> DataFrame:
    """(source, name, value) of a settings section; value is the attribute n, else the text. documents: source, xml.

    A document without the section gives nothing; a malformed one gives a row with a null name.
    """
    schema = "IdxParm struct<param: array<struct<_name:string,_n:string,_VALUE:string>>>, _bad string"
    doc = F.from_xml("xml", schema, {"rowTag": "root", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = documents.select("source", doc.alias("d")).where("d.IdxParm is not null or d._bad is not null")
    rows = rows.select("source", F.explode_outer("d.IdxParm.param").alias("p"))
    return rows.select("source", F.col("p._name").alias("name"), F.coalesce("p._n", "p._VALUE").alias("value"))


def registrations(documents: DataFrame) -> DataFrame:
    """(name, path, id, read_only, config_file) of valid registrations, in order of the name whatever its case.

    documents: source, xml with one section element, its attributes name, path, id and readonly.
    """
    schema = "_name string, _path string, _id string, _readonly string"
    doc = F.from_xml("xml", schema, {"rowTag": REGISTRY_SECTION, "mode": "PERMISSIVE"})
    rows = documents.select("source", doc.alias("d")).select(F.trim("d._name").alias("name"), F.trim("d._path").alias("path"), F.col("d._id").alias("id"), F.coalesce(F.lower("d._readonly").isin("1", "true"), F.lit(False)).alias("read_only"), F.col("source").alias("config_file"))
    return rows.where("name <> '' and path <> ''").orderBy(F.lower("name"), "name")


def read_registrations(spark: SparkSession, folder: str) -> DataFrame:
    """registrations() of the idx_*.xml files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "idx_*.xml").load(folder)
    return registrations(files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source"), F.decode("content", "UTF-8").alias("xml")))


def folder_pattern(xml: Column, element: str = "ConfigFile") -> Column:
    """What the folders' section says of an element; null if it says nothing or is malformed."""
    schema = f"section array<struct<_name:string,{element}:string>>"
    doc = F.from_xml(xml, schema, {"rowTag": "root", "mode": "PERMISSIVE"})
    return F.get(F.filter(doc["section"], lambda x: x["_name"] == FOLDERS_SECTION), F.lit(0))[element]


def config_folder(pattern: str | None, application_data: str) -> str:
    """The folder of registrations: the pattern with its placeholder, whatever its case, filled in; else config."""
    if pattern is None:
        return f"{application_data}/config"
    return re.sub(re.escape("$(ApplicationData)"), lambda _: application_data, pattern, flags=re.IGNORECASE)


def delimiter(text: str | None, default: str = ",") -> str:
    """A delimiter as an option spells it: one character, or the word tab."""
    if not text:
        return default
    if text.lower() == "tab" or text == "\\t":
        return "\t"
    if len(text) != 1:
        raise ValueError(f"a delimiter is one character or 'tab', not {text!r}")
    return text


def whole_number(text: str | None, name: str = "option") -> int | None:
    """A whole number as an option spells it."""
    if text is None:
        return None
    if not re.fullmatch(r"\s*[+-]?[0-9]+\s*", text):
        raise ValueError(f"{name} is a whole number, not {text!r}")
    return int(text)


def resolve(registered: DataFrame, path: str | None = None, name: str | None = None) -> str:
    """The path of a store: as given, else of the one registration of that name, whatever its case."""
    if path:
        return path
    if not name:
        raise ValueError("give a path or a name")
    found = [r["path"] for r in registered.where(F.lower("name") == name.lower()).select("path").limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"no registration is named {name}" if not found else f"more than one registration is named {name}")
    return found[0]


def labels(registered: DataFrame, paths: DataFrame) -> DataFrame:
    """path, label: a store's registered name (the first, if there are more), else the last part of its path."""
    plain = lambda c: F.rtrim(c, F.lit("\\/"))
    # a row a registration
    known = registered.groupBy(F.lower(plain(F.col("path"))).alias("_key")).agg(F.min_by("name", F.struct(F.lower("name"), F.col("name"))).alias("_name"))
    last = F.regexp_extract(plain(F.col("path")), r"([^\\/]*)$", 1)
    return paths.join(known, F.lower(plain(F.col("path"))) == F.col("_key"), "left").select("path", F.coalesce("_name", last).alias("label"))


def label(registered: DataFrame, path: str) -> str:
    return labels(registered, registered.sparkSession.createDataFrame([(path,)], "path string")).first()["label"]
