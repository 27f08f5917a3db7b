"""Queries against their SQL, and the invariants of the accounting."""

import decimal
import os

import pytest
from hypothesis import given
from hypothesis import strategies as st

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Left to the driver's own comparison: these repeat the whole cost report, which owner_cost and folder_rollup cover.
HEAVY = {"reconciliation", "dictionary_split", "top_files", "pareto_90", "closure_accounting", "folder_ranking", "treemap_rows", "treemap_closure", "skip_entries", "treemap_validates", "cost_overview", "report_top_files", "report_reconciliation", "direct_file_bytes"}

from tallyspark.plans.queries import ORACLES, QUERIES  # noqa: E402


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(ORACLES) - HEAVY))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(ORACLES[name])
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_books_balance_and_treemap_loads(spark, tmp_path):
    from tallyspark.operators import hierarchy, treemap, validate
    from tallyspark.plans import fixtures

    report = fixtures.texts_report(spark, SF)
    assert report.closure().first()["off_by"] == 0
    shares = report.rows.selectExpr("sum(shared_share) AS s").first()["s"]
    assert shares == report.totals.first()["shared_dictionary"]
    tree = hierarchy.build_tree(hierarchy.folder_table(report.extra["store"]), report.rows)
    made = treemap.of_tree(tree, "Texts")
    treemap.write_treemap(made, str(tmp_path / "map"))
    summary, findings = validate.validate(validate.read_lines(spark, str(tmp_path / "map")))
    row = summary.first()
    assert row["ok"] and row["child_sums"] and row["dropped"] == 0
    placed = tree.placed.where("place <> 'omitted'").selectExpr("sum(apportioned_bytes) AS s").first()["s"]
    assert row["root_physical"] == placed


def test_csv_file_has_mark_and_crlf(spark, tmp_path):
    from tallyspark.operators.export import write_csv

    for _ in range(2):  # an older file gives way
        write_csv(spark.createDataFrame([(1, "a,b"), (2, " x")], "i int, v string"), str(tmp_path / "new" / "out.csv"), order=["i"])
    assert (tmp_path / "new" / "out.csv").read_bytes().decode() == '\ufeffi,v\r\n1,"a,b"\r\n2," x"\r\n'
    write_csv(spark.createDataFrame([(1, "a,b")], "i int, v string"), str(tmp_path / "tabs"), delimiter="tab", bom=False)
    assert (tmp_path / "tabs").read_bytes() == b"i\tv\r\n1\ta,b\r\n"


def test_options():
    from tallyspark.sources.settings import config_folder, delimiter, whole_number

    assert [delimiter(x) for x in (None, "", "TAB", "\\t", ";")] == [",", ",", "\t", "\t", ";"]
    assert [whole_number(x) for x in (None, " -7 ", "12")] == [None, -7, 12]
    for bad in (lambda: delimiter("ab"), lambda: whole_number("1.5")):
        with pytest.raises(ValueError):
            bad()
    assert config_folder(None, "/a") == "/a/config" and config_folder("$(applicationDATA)/x", "/a") == "/a/x"


def test_store_round_trip(spark, tmp_path):
    from tallyspark.plans import fixtures
    from tallyspark.sources.store import Store, list_directory

    store = fixtures.texts_store(spark, SF)
    store.store_files = spark.createDataFrame([(0, "", "_0.prx", 5)], "segment int, container string, name string, length bigint")
    store.to_parquet(str(tmp_path))
    again = Store.from_parquet(spark, str(tmp_path))
    assert again.counts().collect() == store.counts().collect()
    assert list_directory(spark, str(tmp_path / "docs.parquet")).count() > 0


def test_registrations_resolve(spark):
    from tallyspark.plans.queries import REGISTRY
    from tallyspark.sources import settings

    known = settings.registrations(spark.createDataFrame(REGISTRY, "source string, xml string"))
    assert settings.resolve(known, name="MAIL") == "D:\\mail"
    assert settings.resolve(known, path="here") == "here"
    with pytest.raises(ValueError):
        settings.resolve(known, name="gone")
    assert settings.label(known, "d:\\OLD\\") == "archive"
    assert settings.config_folder("$(ApplicationData)/x", "/a") == "/a/x"


@given(st.text(alphabet='a",b', max_size=30))
def test_split_line_never_loses_unquoted_text(line):
    from tallyspark.operators.validate import split_line

    fields = split_line(line)
    if '"' not in line:
        want = line.split(",")
        assert fields == (want[:-1] if want[-1] == "" else want)


def test_two_level_windows_equal_plain_ones(spark):
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    from tallyspark.operators.windows import descending_block, in_order, running_sum

    df = spark.range(500).selectExpr("id % 3 AS g", "(id * 7919) % 1009 AS o", "id * id % 97 AS v")
    w = W.partitionBy("g").orderBy("o")
    got = in_order(df, ["g"], F.expr("o div 50"), ["o"], "r", {"v": "before"})
    one = in_order(df, ["g"], F.lit(0), ["o"], "r", {"v": "before"})
    assert {tuple(r) for r in one.select("g", "o", "v", "before", "r").collect()} == {tuple(r) for r in got.select("g", "o", "v", "before", "r").collect()}
    want = df.withColumn("before", F.lag("v").over(w)).withColumn("r", F.row_number().over(w) - 1)
    cols = ["g", "o", "v", "before", "r"]
    assert {tuple(r) for r in got.select(cols).collect()} == {tuple(r) for r in want.select(cols).collect()}
    total = running_sum(df, descending_block(F.col("v")), [F.desc("v"), F.col("o"), F.col("g")], "v", "cum", "rank")
    order = W.orderBy(F.desc("v"), "o", "g")
    want = df.withColumn("cum", F.sum("v").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("rank", F.row_number().over(order))
    assert {tuple(r) for r in total.select("g", "o", "cum", "rank").collect()} == {tuple(r) for r in want.select("g", "o", "cum", "rank").collect()}
