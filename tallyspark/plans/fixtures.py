"""Index stores derived from the driver's tables, in Spark; oracles.py has the same in DuckDB's SQL.

orders store: a folder tree (region, nation, customer), an item per order, and status records for most of them.
texts store: documents as items of an inverted index, with postings, folders by language and source, and files.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cost import COUNTERS, CostReport, cost
from ..operators.windows import in_order
from ..sources.store import Store
from .shared import written

EPOCH = 11_644_473_600_000_000  # microseconds from 1601 to 1970


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fields(*pairs: tuple[str, str]) -> str:
    """A map of arrays from (field, expression); an expression of null leaves the field out."""
    entries = ", ".join(f"struct('{f}' AS key, {e} AS value)" for f, e in pairs)
    return f"map_from_entries(filter(array({entries}), e -> e.value is not null)) AS fields"


def one(e: str) -> str:
    return f"CASE WHEN ({e}) IS NOT NULL THEN array({e}) END"


_stores: dict[tuple, tuple[SparkSession, Store]] = {}


def once(make: Callable[[SparkSession, str], Store]) -> Callable[[SparkSession, str], Store]:
    """The derived store, written as tables once a session and folder, as a store is before it is looked into."""

    @functools.wraps(make)
    def kept(spark: SparkSession, sf_dir: str) -> Store:
        key = (make.__name__, id(spark), spark.sparkContext.applicationId, sf_dir)
        if key not in _stores:
            store = make(spark, sf_dir)
            _stores[key] = spark, dataclasses.replace(store, docs=written(store.docs))
        return dataclasses.replace(_stores[key][1])

    return kept


@once
def orders_store(spark: SparkSession, sf_dir: str) -> Store:
    t = lambda n: table(spark, sf_dir, n)
    folder = lambda df, i, p, n, d: df.selectExpr("0 AS segment", f"{d} AS doc_id", "false AS deleted", _fields(("fldrid", one(i)), ("fldrpid", one(p)), ("fldrnm", one(n))))
    region = folder(t("region"), "concat('r', r_regionkey)", "'root'", r"CASE WHEN r_regionkey = 4 THEN '\\\\?\\UNC\\server\\share' ELSE concat('\\\\?\\', char(65 + r_regionkey), ':') END", "1000000000 + cast(r_regionkey AS bigint)")
    nation = folder(t("nation"), "concat('n', n_nationkey)", "concat('r', n_regionkey)", "n_name", "1100000000 + cast(n_nationkey AS bigint)")
    customer = folder(t("customer"), "concat('c', c_custkey)", "concat('n', c_nationkey)", "c_name", "1200000000 + c_custkey")
    orders = t("orders").withColumn("t", (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)") + EPOCH) * 10).withColumnRenamed("o_orderkey", "k")
    items = orders.selectExpr(
        "0 AS segment", "2 * k AS doc_id", "k % 97 = 0 AS deleted",
        _fields(
            ("id", one("concat('c', o_custkey, ':order-', k)")),
            ("name", one("concat('Order-', k, '.', CASE k % 3 WHEN 0 THEN 'txt' WHEN 1 THEN 'log' ELSE '' END)")),
            ("sizenr", one("CASE k % 50 WHEN 7 THEN 'n/a' WHEN 8 THEN ' ' ELSE cast(cast(round(o_totalprice * 100) AS bigint) AS string) END")),
            ("modft", one("CASE WHEN k % 50 = 9 THEN '0' ELSE cast(t AS string) END")),
            ("createft", one("cast(t - 864000000000 * (k % 30) + k % 10 AS string)")),
            ("attrx", one("CASE k % 5 WHEN 0 THEN '20' WHEN 1 THEN '21' WHEN 2 THEN '2020' WHEN 3 THEN '10' ELSE '80020' END")),
            ("itemtype", one("CASE WHEN k % 11 = 0 THEN '4' ELSE '1' END")),
            ("exinfo", "CASE WHEN k % 7 = 0 THEN array(lower(hex(k % 100)), lower(hex(k % 3))) ELSE array(lower(hex(k % 100))) END"),
        ),
    )
    metas = orders.where("k % 10 <> 0").selectExpr(
        "0 AS segment", "2 * k + 1 AS doc_id", "k % 97 = 0 AS deleted",
        _fields(("mid", one("concat('c', o_custkey, ':order-', k)")), ("idxdt", one("cast(t + 10000000 AS string)")), ("idxfl", one("lower(hex(k % 6))")), ("idxtrm", one("lower(hex(37 * k + 1))")), ("moddt", one("lower(hex(t))"))),
    )
    docs = region.unionByName(nation).unionByName(customer).unionByName(items).unionByName(metas)
    infos = spark.createDataFrame([(0, f, i, x, False, False, False, False) for i, (f, x) in enumerate([("attrx", True), ("content", True), ("id", True), ("name", True), ("sizenr", False)])], INFOS)
    return Store(docs, None, infos, None)


INFOS = "segment int, field string, number int, is_indexed boolean, has_norms boolean, has_freqs boolean, has_positions boolean, has_payloads boolean"
#: Header bytes a segment of the derived store's files, and files of no model.
HEADER, DICTIONARY_HEADER, SKIP_BYTES = 4, 24, 3


@once
def texts_store(spark: SparkSession, sf_dir: str) -> Store:
    """Without files; see with_files."""
    d = table(spark, sf_dir, "documents").selectExpr("doc_id AS k", "text", "coalesce(lang, 'none') AS lang", "coalesce(source, 'none') AS source")
    key = "concat('f-', lang, '-', source, ':doc-', k)"
    items = d.selectExpr(
        "cast(k % 3 AS int) AS segment", "2 * k AS doc_id", "k % 97 = 5 AS deleted",
        _fields(
            ("id", one(key)), ("name", one("concat('Doc-', k, CASE WHEN k % 4 = 0 THEN '.md' ELSE '.txt' END)")), ("sizenr", one("cast(length(text) AS string)")),
            ("modft", one("cast(132539328000000000 + k * 10000000 AS string)")), ("attrx", one("CASE WHEN k % 40 = 3 THEN '10' ELSE '20' END")), ("text", one("text")),
        ),
    )
    metas = d.where("k % 4 = 1").selectExpr("cast(k % 3 AS int) AS segment", "2 * k + 1 AS doc_id", "k % 97 = 5 AS deleted", _fields(("mid", one(key)), ("idxfl", one("lower(hex(k % 6))"))))
    start = 1 << 40
    langs = d.select("lang").distinct().selectExpr("0 AS segment", f"{start} + pmod(xxhash64(lang), 1000000) AS doc_id", "false AS deleted", _fields(("fldrid", one("concat('l-', lang)")), ("fldrpid", one("'t'")), ("fldrnm", one("lang")), ("modft", one("cast(132539328000000000 + 10000000 * ascii(lang) AS string)"))))
    sources = d.select("lang", "source").distinct().selectExpr("0 AS segment", f"{2 * start} + pmod(xxhash64(lang, source), 1000000) AS doc_id", "false AS deleted", _fields(("fldrid", one("concat('f-', lang, '-', source)")), ("fldrpid", one("concat('l-', lang)")), ("fldrnm", one("source"))))
    top = spark.range(1).selectExpr("0 AS segment", f"{3 * start} AS doc_id", "false AS deleted", _fields(("fldrid", one("'t'")), ("fldrpid", one("'root'")), ("fldrnm", one(r"'\\\\?\\T:'"))))
    index = spark.range(1).selectExpr("0 AS segment", f"{4 * start} AS doc_id", "false AS deleted", _fields(("idxv", one("'7'"))))
    docs = items.unionByName(metas).unionByName(langs).unionByName(sources).unionByName(top).unionByName(index)
    # numbers within the segment, in order of scan
    numbers = written(in_order(docs.select("segment", "doc_id"), ["segment"], F.expr("doc_id div 65536"), ["doc_id"], "doc").withColumn("doc", F.col("doc").cast("int")))
    docs = docs.join(numbers, ["segment", "doc_id"])
    numbers = numbers.where(f"doc_id < {start} and doc_id % 2 = 0").select("segment", "doc", F.expr("doc_id div 2 AS k"))
    rows = d.select("k", "text", "lang", "source").join(numbers, "k")
    words = rows.select("segment", "doc", F.posexplode(F.split("text", "[ \n]+")).alias("pos", "term")).where("term <> ''")
    content = words.groupBy("segment", "doc", "term").agg(F.sort_array(F.collect_list("pos")).alias("positions")).select("segment", F.lit("content").alias("field"), "term", "doc", F.size("positions").alias("freq"), "positions")
    single = lambda f: rows.select("segment", F.lit(f).alias("field"), F.col(f).alias("term"), "doc", F.lit(1).alias("freq"), F.lit(None).cast("array<int>").alias("positions"))
    postings = written(content.unionByName(single("lang")).unionByName(single("source")).withColumn("payloads", F.lit(None).cast("array<int>")))
    flags = [("content", 0, True, True, True, True, False), ("lang", 1, True, False, False, False, False), ("source", 2, True, False, False, False, False), ("text", 3, False, False, False, False, False), ("id", 4, False, False, False, False, False)]
    infos = spark.createDataFrame([(s, *f) for s in range(3) for f in flags], INFOS)
    return Store(docs, postings, infos, None)


def files_of(spark: SparkSession, report: CostReport) -> DataFrame:
    """Files whose residuals are known: headers, skip entries, two kinds the model leaves out; one listed twice, one not counted."""
    sums = report.rows.agg(*(F.sum(c).alias(c) for c in COUNTERS)).join(report.totals)
    lines = [
        (".prx", "position_bytes", 0), (".frq", f"posting_bytes + {SKIP_BYTES} * skip_entries", 0), (".fdt", "stored_bytes", 2 * HEADER), (".fdx", "0", HEADER),
        (".nrm", "norm_bytes", 3 * HEADER), (".tis", "sole_dictionary + shared_dictionary", DICTIONARY_HEADER), (".tii", "0", 777), (".fnm", "0", 99), (".del", "0", 5),
    ]
    rows = sums.select(F.explode(F.array(*(F.struct(F.lit(f"_0{e}").alias("name"), F.expr(f"cast({x} + {more} AS bigint)").alias("length")) for e, x, more in lines))).alias("x")).select(F.lit(0).alias("segment"), F.lit("").alias("container"), "x.*")
    return rows.unionByName(rows.where("name = '_0.prx'").withColumn("name", F.upper("name")))


def texts_report(spark: SparkSession, sf_dir: str) -> CostReport:
    """The cost report of the texts store, reconciled with its derived files."""
    from ..operators.cost import reconcile
    store = texts_store(spark, sf_dir)
    empty = spark.createDataFrame([], "segment int, container string, name string, length bigint")
    store.store_files = empty
    report = cost(store)
    report.rows, report.totals = written(report.rows), written(report.totals)
    store.store_files = files_of(spark, report)
    report.checks = reconcile(store, report.rows, report.totals)
    report.totals = report.totals.drop("store_bytes").join(store.total_bytes())
    report.extra["store"] = store
    return report
