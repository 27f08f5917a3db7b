"""The named queries: each a callable of (spark, sf_dir), with its statement in DuckDB's SQL where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytemodel as B
from ..functions import decode as D
from ..functions import text as T
from ..operators import cost as C
from ..operators import export as X
from ..operators import hierarchy as H
from ..operators import profile as P
from ..operators import report as L
from ..operators import treemap as M
from ..operators import validate as V
from ..sources import settings as S
from ..sources.store import Store, first, stored_string, stored_text
from . import fixtures as fx
from . import oracles as o
from .shared import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rows(spark: SparkSession, schema: str, values: list[tuple]) -> DataFrame:
    return spark.createDataFrame(values, schema)


# ---- decoding ----------------------------------------------------------------------------------------------------


@query(o.orders(f"SELECT doc_id, {o.number('sizenr')} AS size_bytes, {o.stamp('modified')} AS modified, {o.stamp('created')} AS created, {o.stamp('created', 'T', False)} AS created_short, {o.attribute_names('mask')} AS attributes, CASE k % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'RA' WHEN 2 THEN 'A' WHEN 3 THEN '' ELSE 'A' END AS letters, is_folder FROM items WHERE NOT deleted"))
def decode_items(spark, sf_dir):
    """P1-P6, P9, F1, F4 over live items."""
    items = fx.orders_store(spark, sf_dir).of_kind("item")
    mask = D.hex_number(first("attrx"))
    created = D.ticks(first("createft"))
    return items.select("doc_id", D.decimal_number(first("sizenr")).alias("size_bytes"), D.timestamp_export(D.ticks(first("modft"))).alias("modified"), D.timestamp_export(created).alias("created"), D.timestamp_treemap(created).alias("created_short"), D.attribute_names(mask).alias("attributes"), D.attribute_letters(mask).alias("letters"), D.is_folder_item(first("itemtype"), first("attrx")).alias("is_folder"))


@query(o.orders(f"SELECT doc_id, flags::BIGINT AS flags, CASE WHEN flags % 2 = 1 THEN 'Y' ELSE 'N' END AS content_indexed, {o.FLAG_TEXT} AS other_bits, terms, moddt = idxdt - 10000000 AS same_ticks, {o.stamp('moddt')} AS modified FROM metas"))
def decode_metas(spark, sf_dir):
    """P1, P2, P7, P8 over status records; hex ticks equal the decimal ones."""
    metas = fx.orders_store(spark, sf_dir).of_kind("meta")
    flags = D.hex_number(first("idxfl"))
    return metas.select("doc_id", flags.alias("flags"), D.content_indexed(flags).alias("content_indexed"), D.other_flag_bits(flags).alias("other_bits"), D.hex_number(first("idxtrm")).alias("terms"), (D.ticks(first("moddt"), "hexticks") == D.ticks(first("idxdt")) - 10_000_000).alias("same_ticks"), D.timestamp_export(D.ticks(first("moddt"), "hexticks")).alias("modified"))


NUMBERS = [(1, "", "decimal", None), (2, "  ", "decimal", None), (3, " 12 ", "decimal", 12), (4, "+5", "decimal", 5), (5, "-5", "decimal", -5), (6, "1.5", "decimal", None), (7, "1e3", "decimal", None), (8, "1_000", "decimal", None), (9, "zz", "hex", None), (10, "1g", "hex", None), (11, "0x20", "hex", 32), (12, "ffffffffffffff0", "hex", 1152921504606846960), (13, "ffffffffffffffff", "hex", -1), (14, "00000000000000000010", "hex", 16), (15, "1dd03d2b14f9081", "hexticks", 134267767343779969), (16, "20", "attributes", 32), (17, "x", "text", None), (18, None, "decimal", None)]


@query(o.golden("id, n", [(i, n) for i, _, _, n in NUMBERS]))
def decode_numbers(spark, sf_dir):
    """Odd spellings by encoding."""
    df = rows(spark, "id int, raw string, encoding string, want bigint", NUMBERS)
    return df.select("id", D.number(F.col("raw"), F.col("encoding")).alias("n"))


MASKS = [(1, 0, "", "", False), (2, 1, "ReadOnly", "R", False), (3, 32, "Archive", "A", False), (4, 16, "Directory", "", True), (5, 33, "ReadOnly|Archive", "RA", False), (6, 524320, "524320", "A", False), (7, None, "", "", False), (8, 55, "ReadOnly|Hidden|System|Directory|Archive", "RHSA", True), (9, 512, "SparseFile", "Z", False), (10, 22528, "Compressed|Offline|Encrypted", "CEO", False)]


@query(o.golden("id, names, letters, directory, kind", [(i, n, x, d, "0x00000008") for i, _, n, x, d in MASKS]))
def attribute_masks(spark, sf_dir):
    """P5, P6, P9, P10, P27."""
    m = F.col("mask")
    df = rows(spark, "id int, mask bigint, names string, letters string, directory boolean", MASKS)
    return df.select("id", D.attribute_names(m).alias("names"), D.attribute_letters(m).alias("letters"), D.has_attribute(m, D.DIRECTORY).alias("directory"), D.item_type_hex(F.lit(M.TYPE_FILE)).alias("kind"))


@query(o.golden("field, encoding", [("sizenr", "decimal"), ("moddt", "hexticks"), ("idxfl", "flags"), ("attrx", "attributes"), ("other", "text")]))
def field_encodings(spark, sf_dir):
    """P12."""
    df = rows(spark, "field string", [("sizenr",), ("moddt",), ("idxfl",), ("attrx",), ("other",)])
    return df.select("field", D.encoding_of(F.col("field")).alias("encoding"))


ITEM_IDS = [("12:a:b", "12", "a:b"), ("x", "", "x"), ("", "", ""), ("7:", "7", "")]


@query(o.golden("id, folder_id, name", ITEM_IDS))
def item_id_split(spark, sf_dir):
    """The first colon parts."""
    df = rows(spark, "id string, a string, b string", ITEM_IDS)
    return df.select("id", T.item_folder_id(F.col("id")).alias("folder_id"), T.item_key_name(F.col("id")).alias("name"))


PATHS = [
    (1, r"\\?\C:", "C:", True, "C:", "", "C:|x"),
    (2, r"\\?\UNC\srv\share\a", r"\\srv\share\a", True, r"\\srv\share|a", "", None),
    (3, r"C:\dir\\file.txt", r"C:\dir\\file.txt", False, "C:|dir|file.txt", "txt", None),
    (4, "<cycle>\\a", "<cycle>\\a", True, "<cycle>|a", "", None),
    (5, "plain.", "plain.", False, "plain.", "", None),
    (6, 'say "hi"\n', 'say "hi"\n', False, 'say "hi"\n', "", None),
]


@query(o.golden("id, root, real, parts, ext, clean, safe", [(i, r, x, p, e, s.replace('"', "'").replace("\n", " "), '"' not in s) for i, s, r, x, p, e, _ in PATHS]))
def path_text(spark, sf_dir):
    """P14, P16, P21-P24."""
    df = rows(spark, "id int, raw string", [x[:2] for x in PATHS])
    root = T.normalize_root(F.col("raw"))
    return df.select("id", root.alias("root"), T.is_real_root(root).alias("real"), F.array_join(T.split_path(root), "|").alias("parts"), T.extension(F.col("raw")).alias("ext"), T.sanitize(F.col("raw")).alias("clean"), T.is_safe(F.col("raw")).alias("safe"))


@query(o.golden("id, joined, short", [(1, r"C:\a", "abcdefghij"), (2, "a", "…fghijklmno"), (3, "C:\\a", ""), (4, "C:", "x")]))
def path_join(spark, sf_dir):
    """P17-P19."""
    df = rows(spark, "id int, head string, tail string, long string", [(1, "C:", "a", "abcdefghij"), (2, "", "a", "abcdefghijklmno"), (3, "C:\\", "a", ""), (4, "C:", "", "x")])
    return df.select("id", T.join_path(F.col("head"), F.col("tail")).alias("joined"), T.shorten(F.col("long"), 11).alias("short"))


CSV = [(1, "a,b", '"a,b"'), (2, 'q"q', '"q""q"'), (3, " edge", '" edge"'), (4, "edge ", '"edge "'), (5, "two\nlines", '"two\nlines"'), (6, "", ""), (7, None, ""), (8, "é", "é"), (9, "c\rr", '"c\rr"')]


@query(o.golden("id, line", [(i, f"{i},{w}") for i, _, w in CSV]))
def csv_lines(spark, sf_dir):
    """K1."""
    df = rows(spark, "id int, value string, want string", CSV)
    return df.select("id", T.csv_line([F.col("id"), F.col("value")]).alias("line"))


# ---- byte model --------------------------------------------------------------------------------------------------

VINTS = [(0, 1), (127, 1), (128, 2), (16383, 2), (16384, 3), (2097151, 3), (2097152, 4), (-1, 10), (9223372036854775807, 9)]


@query(o.golden("x, n", VINTS))
def vint_lengths(spark, sf_dir):
    """B1."""
    return rows(spark, "x bigint, want bigint", VINTS).select("x", B.vint(F.col("x")).alias("n"))


@query(o.golden("name, bytes", [("posting 0,1", 1), ("posting 63,1", 1), ("posting 64,1", 2), ("posting 1,2", 2), ("docs only 128", 2), ("payload changed", 5), ("payload same", 4), ("entry df 1", 9), ("entry df 17", 10), ("skips 16", 0), ("skips 17", 1), ("skips 255", 15), ("skips 256", 17), ("prefix abc abd", 2), ("prefix of none", 0), ("prefix ab abc", 2), ("payload positions", 12), ("negative stops", 1), ("share 0", 4), ("share 1", 3), ("share 2", 3)]))
def byte_model_vectors(spark, sf_dir):
    """The golden vectors."""
    i = lambda n: F.lit(n).cast("bigint")
    yes, no = F.lit(True), F.lit(False)
    cases = {
        "posting 0,1": B.posting(i(0), i(1), yes), "posting 63,1": B.posting(i(63), i(1), yes), "posting 64,1": B.posting(i(64), i(1), yes), "posting 1,2": B.posting(i(1), i(2), yes), "docs only 128": B.posting(i(128), i(9), no),
        "payload changed": B.position(i(1), yes, i(3), yes), "payload same": B.position(i(1), yes, i(3), no),
        "entry df 1": B.term_entry(i(2), i(3), i(0), i(1), i(0), i(0)), "entry df 17": B.term_entry(i(2), i(3), i(0), i(17), i(0), i(0)),
        **{f"skips {n}": B.skip_entries(i(n)) for n in (16, 17, 255, 256)},
        "prefix abc abd": B.shared_prefix(F.lit("abc"), F.lit("abd")), "prefix of none": B.shared_prefix(F.lit(""), F.lit("x")), "prefix ab abc": B.shared_prefix(F.lit("ab"), F.lit("abc")),
        # deltas 1, 1, 2; lengths 3 (changed), 3 (same), 0 (changed): 1+1+3, 1+3, 1+1+0, and one more same: 1
        "payload positions": B.positions(F.array(*map(F.lit, (1, 2, 4, 5))), F.array(*map(F.lit, (3, 3, 0, 0)))), "negative stops": B.positions(F.array(*map(F.lit, (3, -1, 5)))),
        **{f"share {n}": B.apportion(i(10), i(3), i(n)) for n in range(3)},
    }
    return spark.range(1).select(F.explode(F.create_map(*(x for k, v in cases.items() for x in (F.lit(k), v.cast("bigint"))))).alias("name", "bytes"))


def _postings(spark, sf_dir):
    return C.posting_costs(fx.texts_store(spark, sf_dir))


@query(o.texts("SELECT segment, field, term, df, frq AS freq_bytes, prx AS prox_bytes FROM terms"))
def posting_bytes(spark, sf_dir):
    """Per term."""
    return _postings(spark, sf_dir).groupBy(*C.TERM).agg(F.count(F.lit(1)).alias("df"), F.sum("freq_bytes").alias("freq_bytes"), F.sum("prox_bytes").alias("prox_bytes"))


@query(o.texts("SELECT segment, field, term, df, entry_bytes, skip_entries FROM entries"))
def term_dictionary_bytes(spark, sf_dir):
    """W3, B5, B6, B7."""
    return C.term_entries(_postings(spark, sf_dir)).drop("last_block")


@query(o.texts("SELECT segment, count(*) AS terms, sum(skip_entries)::BIGINT AS skip_entries FROM entries GROUP BY segment"))
def skip_entries(spark, sf_dir):
    """B6, S17."""
    return C.term_entries(_postings(spark, sf_dir)).groupBy("segment").agg(F.count(F.lit(1)).alias("terms"), F.sum("skip_entries").alias("skip_entries"))


@query(o.texts("SELECT segment, doc::INT AS doc, posting_bytes, position_bytes, sole_term_bytes, shared_term_bytes, shared_term_count, shared_share FROM by_doc"))
def shared_apportionment(spark, sf_dir):
    """What each document's postings and terms cost."""
    postings = written(_postings(spark, sf_dir))
    return C.document_costs(postings, C.term_entries(postings))


@query(o.texts("SELECT segment, doc_id, stored_bytes FROM numbered WHERE kind IN ('item', 'meta', 'index')"))
def stored_bytes(spark, sf_dir):
    """S3, S7, B4, W7."""
    store = fx.texts_store(spark, sf_dir)
    named = store.kinds().where(F.map_contains_key("fields", F.lit("fldrid")) == F.lit(False)).select("segment", "doc", "doc_id")
    return named.join(store.stored_bytes(), ["segment", "doc"]).select("segment", "doc_id", "stored_bytes")


# ---- cost --------------------------------------------------------------------------------------------------------


@query(o.texts('SELECT owner AS "Owner", is_folder AS "IsFolder", doc_count AS "Docs", exclusive_bytes AS "ExclusiveBytes", stored_bytes AS "StoredBytes", norm_bytes AS "NormBytes", posting_bytes AS "PostingBytes", position_bytes AS "PositionBytes", sole_term_bytes AS "SoleTermBytes", shared_term_bytes AS "SharedTermBytes", shared_term_count AS "SharedTermCount" FROM cost_rows'))
def owner_cost(spark, sf_dir):
    """The cost report's rows."""
    return fx.texts_report(spark, sf_dir).csv_rows()


@query(o.texts("""SELECT "check", actual, computed, actual - computed AS residual, CASE WHEN actual = computed THEN 'exact' WHEN computed = 0 THEN 'index-wide' WHEN "check"[1:4] = '.frq' THEN 'skip lists' WHEN "check"[1:4] = '.tis' THEN 'header and skip pointers' ELSE 'segment headers' END AS class FROM checks"""))
def reconciliation(spark, sf_dir):
    """A8, A9, S11, U4, P26."""
    return fx.texts_report(spark, sf_dir).explained()


@query(o.texts("""SELECT e AS exclusive, s AS shared, a - c AS unattributed, a AS actual, round(e * 100.0 / a, 1)::DOUBLE AS exclusive_pct, round(s * 100.0 / a, 1)::DOUBLE AS shared_pct, round((a - c) * 100.0 / a, 1)::DOUBLE AS unattributed_pct, a - (e + s + a - c) AS off_by
FROM (SELECT (SELECT sum(exclusive_bytes) FROM cost_rows)::BIGINT AS e, (SELECT shared FROM totals) AS s, sum(actual)::BIGINT AS a, sum(computed)::BIGINT AS c FROM checks)"""))
def closure_accounting(spark, sf_dir):
    """The books balance."""
    return fx.texts_report(spark, sf_dir).closure().withColumns({c: F.col(c).cast("double") for c in ("exclusive_pct", "shared_pct", "unattributed_pct")})


@query(o.texts("SELECT sole AS sole_dictionary, shared AS shared_dictionary, 1::BIGINT AS norm_fields, 18::BIGINT AS flat_cost, skips AS skip_entries, 3.0::DOUBLE AS skip_bytes_per_entry FROM totals"))
def dictionary_split(spark, sf_dir):
    """A12, A13."""
    return fx.texts_report(spark, sf_dir).dictionary_split()


@query(o.texts("SELECT exclusive_bytes AS exclusive, position_bytes AS positions, posting_bytes AS postings, stored_bytes AS stored, sole_term_bytes AS sole_terms, shared_term_bytes AS shared, owner AS file FROM files WHERE rn <= 15"))
def top_files(spark, sf_dir):
    """O1, O2, F7."""
    return fx.texts_report(spark, sf_dir).top_files(15)


@query(o.texts("SELECT top_files, files, exclusive, round(top_files * 100.0 / files, 1)::DOUBLE AS percent FROM (SELECT min(rn) FILTER (cum * 10 >= total * 9) AS top_files, count(*) AS files, any_value(total)::BIGINT AS exclusive FROM (SELECT *, sum(exclusive_bytes) OVER () AS total FROM files))"))
def pareto_90(spark, sf_dir):
    """W5."""
    return fx.texts_report(spark, sf_dir).pareto().withColumn("percent", F.col("percent").cast("double"))


@query(o.texts("SELECT stored AS stored_bytes, norms AS norm_bytes, postings AS posting_bytes, positions AS position_bytes, sole AS sole_dictionary, shared AS shared_dictionary, skips AS skip_entries, 1::BIGINT AS norm_fields, false AS has_payloads, (SELECT count(*) FROM numbered) AS max_doc, (SELECT sum(actual) FROM checks)::BIGINT AS store_bytes FROM totals"))
def cost_overview(spark, sf_dir):
    """A5: what was computed of each kind, over the whole store."""
    return fx.texts_report(spark, sf_dir).overview()


@query(o.texts("SELECT segment, doc::INT AS doc, (doc + (SELECT count(*) FROM numbered m WHERE m.segment < n.segment))::BIGINT AS number FROM numbered n"))
def global_numbers(spark, sf_dir):
    """A document's number in the whole index."""
    return fx.texts_store(spark, sf_dir).global_numbers()


@query(o.texts("""SELECT 1::BIGINT AS line, '     exclusive    positions   postings   stored sole_terms     shared file' AS text UNION ALL
SELECT rn + 1, '  ' || lpad(format('{:,}', exclusive_bytes), 12, ' ') || ' ' || lpad(format('{:,}', position_bytes), 12, ' ') || ' ' || lpad(format('{:,}', posting_bytes), 10, ' ') || ' ' || lpad(format('{:,}', stored_bytes), 8, ' ') || ' ' || lpad(format('{:,}', sole_term_bytes), 10, ' ') || ' ' || lpad(format('{:,}', shared_term_bytes), 10, ' ') || ' ' || owner
FROM (SELECT *, row_number() OVER (ORDER BY exclusive_bytes DESC, owner) AS rn FROM files WHERE rn <= 10)"""))
def report_top_files(spark, sf_dir):
    """K5: the costliest files as lines of text."""
    return L.top_files(fx.texts_report(spark, sf_dir), 10)


@query(o.texts("""SELECT 1::BIGINT AS line, '  check                      actual       computed     residual ' AS text UNION ALL
SELECT row_number() OVER (ORDER BY last, "check") + 1, '  ' || rpad("check", 18, ' ') || ' ' || lpad(format('{:,}', actual), 14, ' ') || ' ' || lpad(format('{:,}', computed), 14, ' ') || ' ' || lpad(format('{:,}', actual - computed), 12, ' ') || ' ' ||
  CASE WHEN last = 1 THEN printf('%.1f%%', computed * 100.0 / actual) || ' attributed' WHEN actual = computed THEN 'exact' WHEN computed = 0 THEN 'index-wide' ELSE printf('%+.2f%%', (actual - computed) * 100.0 / actual) || CASE WHEN "check"[1:4] = '.frq' THEN ' skip lists' WHEN "check"[1:4] = '.tis' THEN ' header and skip pointers' ELSE ' segment headers' END END
FROM (SELECT *, 0 AS last FROM checks UNION ALL SELECT 'TOTAL', sum(actual)::BIGINT, sum(computed)::BIGINT, 1 FROM checks)"""))
def report_reconciliation(spark, sf_dir):
    """K5: the reconciliation as lines of text."""
    return L.reconciliation(fx.texts_report(spark, sf_dir))


VALUES = [(1, "text", 5, b"\x01", "text", "text"), (2, None, 5, b"\x01", "5", ""), (3, None, None, b"\x01\xff", "0x01FF", ""), (4, None, None, None, "", ""), (5, "", 7, None, "", "")]


@query(o.golden("id, shown, costed", [(i, x, y) for i, _, _, _, x, y in VALUES]))
def stored_values(spark, sf_dir):
    """A stored value as a reader shows it and as the cost analysis takes it."""
    df = rows(spark, "id int, text string, num bigint, bin binary", [x[:4] for x in VALUES])
    return df.select("id", stored_text(F.col("text"), F.col("num"), F.col("bin")).alias("shown"), stored_string(F.col("text")).alias("costed"))


# ---- export ------------------------------------------------------------------------------------------------------


@query(o.orders("SELECT folder_id, path FROM paths"))
def folder_paths_recursive(spark, sf_dir):
    """H1, J3, D4."""
    return H.folder_paths(H.folder_table(fx.orders_store(spark, sf_dir)))


BAD = [("a", "b", "A"), ("b", "a", "B"), ("s", "s", "S"), ("m", "gone", "M"), ("k", "m", "K"), ("e", "r", ""), ("f", "e", "F"), ("r", "root", r"\\?\C:"), ("u", "", r"\\?\UNC\srv\x"), ("v", "u", "V"), ("", "r", "nothing"), ("d", "r", "Old"), ("d", "u", "New"), ("t", "b", "T")]


@query(o.golden("folder_id, path", [("a", r"<cycle>\B\A"), ("b", r"<cycle>\A\B"), ("s", r"<cycle>\S"), ("m", r"<unresolved:gone>\M"), ("k", r"<unresolved:gone>\M\K"), ("e", "C:"), ("f", r"C:\F"), ("r", "C:"), ("u", r"\\srv\x"), ("v", r"\\srv\x\V"), ("d", r"\\srv\x\New"), ("t", r"<cycle>\A\B\T")]))
def folder_paths_defects(spark, sf_dir):
    """H1 on cycles, missing parents, empty names and ids, ids given twice."""
    df = rows(spark, "folder_id string, parent_id string, name string, doc_id bigint", [(*x, i) for i, x in enumerate(BAD)])
    return H.folder_paths(H.folders_of(df))


@query(o.orders(f"SELECT {o.EXPORT_COLUMNS} {o.EXPORT_FROM} AND NOT i.is_folder"))
def export(spark, sf_dir):
    """J1, J2, F2, F3, P13-P18."""
    return X.export(fx.orders_store(spark, sf_dir))


@query(o.orders(f"""SELECT {o.EXPORT_COLUMNS}, i.attrx AS raw_attrx, i.created::VARCHAR AS raw_createft, array_to_string(i.exinfo, '|') AS raw_exinfo, i.id AS raw_id, m.idxdt::VARCHAR AS raw_idxdt, format('{{:x}}', m.flags) AS raw_idxfl, format('{{:x}}', m.terms) AS raw_idxtrm, i.itemtype::VARCHAR AS raw_itemtype, CASE WHEN m.k IS NOT NULL THEN i.id END AS raw_mid, format('{{:x}}', m.moddt) AS raw_moddt, i.modft AS raw_modft, i.name AS raw_name, i.sizenr AS raw_sizenr {o.EXPORT_FROM}"""))
def export_raw(spark, sf_dir):
    """C1 with folders and the raw columns that the data has: A3, P15, U2, O8."""
    return X.export(fx.orders_store(spark, sf_dir), include_folders=True, raw=True)


@query(o.orders("SELECT count(*) FILTER (NOT is_folder) AS files, count(*) FILTER (is_folder) AS folders, count(*) FILTER (k % 10 = 0) AS unmatched FROM items WHERE NOT deleted"))
def export_counts(spark, sf_dir):
    """A19."""
    return X.export_counts(fx.orders_store(spark, sf_dir), include_folders=True)


@query(o.orders("SELECT id AS item_id FROM items WHERE NOT deleted AND k % 10 = 0"))
def unmatched_items_anti(spark, sf_dir):
    """J1, as an anti join."""
    store = fx.orders_store(spark, sf_dir)
    return store.of_kind("item").select(first("id").alias("item_id")).join(store.of_kind("meta").select(first("mid").alias("item_id")), "item_id", "left_anti")


# ---- looking into a store ----------------------------------------------------------------------------------------


@query(o.orders("SELECT (SELECT count(*) FROM folder_docs) + (SELECT count(*) FROM items) + (SELECT count(*) FROM o WHERE k % 10 <> 0) AS max_doc, (SELECT count(*) FROM folder_docs) + (SELECT count(*) FROM items WHERE NOT deleted) + (SELECT count(*) FROM metas) AS num_docs, (SELECT count(*) FROM items WHERE deleted) + (SELECT count(*) FROM o WHERE k % 10 <> 0 AND k % 97 = 0) AS num_deleted, '0' AS segments"))
def info_counts(spark, sf_dir):
    """C2, S2, S8."""
    return fx.orders_store(spark, sf_dir).counts()


_LISTED = [("_0.prx", 10), ("segments.gen", 20)]


@query(o.orders("SELECT 'documents' AS section, unnest(['live', 'deleted', 'slots']) AS name, unnest([num_docs, num_deleted, num_docs + num_deleted])::BIGINT AS value FROM (SELECT (SELECT count(*) FROM folder_docs) + (SELECT count(*) FROM items WHERE NOT deleted) + (SELECT count(*) FROM metas) AS num_docs, (SELECT count(*) FROM items WHERE deleted) + (SELECT count(*) FROM o WHERE k % 10 <> 0 AND k % 97 = 0) AS num_deleted) "
    "UNION ALL SELECT 'file', unnest(['_0.prx', 'segments.gen']), unnest([10, 20]) UNION ALL SELECT CASE WHEN f IN ('attrx', 'id', 'name') THEN 'stored, indexed' ELSE 'stored' END, f, (SELECT count(*) FROM items WHERE NOT deleted) FROM (SELECT unnest(['attrx', 'createft', 'exinfo', 'id', 'itemtype', 'modft', 'name', 'sizenr']) AS f) "
    "UNION ALL SELECT 'stored', unnest(['idxdt', 'idxfl', 'idxtrm', 'mid', 'moddt']), (SELECT count(*) FROM metas) UNION ALL SELECT 'stored', unnest(['fldrid', 'fldrnm', 'fldrpid']), (SELECT count(*) FROM folder_docs) UNION ALL SELECT 'indexed only', 'content', NULL"))  # fmt: skip
def index_info(spark, sf_dir):
    """What a store is, in one table."""
    store = fx.orders_store(spark, sf_dir)
    store.store_files = rows(spark, "segment int, container string, name string, length bigint", [(0, "", *x) for x in _LISTED])
    return L.looked_into(store)


_ITEM = ["attrx", "createft", "exinfo", "id", "itemtype", "modft", "name", "sizenr"]
_FIELDS = " UNION ALL ".join([f"SELECT '{f}' AS field, (SELECT count(*) FROM items WHERE NOT deleted) AS docs, {str(f in ('attrx', 'id', 'name', 'sizenr') and f != 'sizenr').lower()} AS also_indexed" for f in _ITEM] + [f"SELECT '{f}', (SELECT count(*) FROM metas), false" for f in ("idxdt", "idxfl", "idxtrm", "mid", "moddt")] + [f"SELECT '{f}', (SELECT count(*) FROM folder_docs), false" for f in ("fldrid", "fldrnm", "fldrpid")])


@query(o.orders(_FIELDS))
def stored_fields(spark, sf_dir):
    """A2, U5, J13."""
    return P.stored_fields(fx.orders_store(spark, sf_dir))


@query(o.golden("field", [("content",)]))
def schema_fields_except(spark, sf_dir):
    """Indexed fields that no document stores."""
    return P.indexed_only(fx.orders_store(spark, sf_dir))


@query(o.orders("SELECT count(*) AS count, v AS value, (('0x' || v)::BIGINT)::VARCHAR AS decoded FROM (SELECT unnest(exinfo) AS v FROM items WHERE NOT deleted) GROUP BY v ORDER BY count DESC, v LIMIT 20"))
def values_topk(spark, sf_dir):
    """C4: A1, O4, P19, P20."""
    return P.values(fx.orders_store(spark, sf_dir), "exinfo", 20)


@query(o.orders("SELECT count(DISTINCT v) AS distinct_values, count(*) AS total_values FROM (SELECT unnest(exinfo) AS v FROM items WHERE NOT deleted)"))
def value_totals(spark, sf_dir):
    """A1."""
    return P.value_totals(fx.orders_store(spark, sf_dir), "exinfo")


@query(o.orders("SELECT doc_id AS doc, f.field, 0 AS n, f.value FROM (SELECT * FROM items WHERE NOT deleted AND k % 3 = 1 ORDER BY doc_id LIMIT 5) i, LATERAL (SELECT unnest(['attrx', 'createft', 'id', 'itemtype', 'modft', 'name', 'sizenr']) AS field, unnest([attrx, created::VARCHAR, id, itemtype::VARCHAR, modft, name, sizenr]) AS value) f"))
def dump_where(spark, sf_dir):
    """F5, F6, O5; single-valued fields."""
    return P.dump(fx.orders_store(spark, sf_dir), 5, where="name", value=".LOG").where("field <> 'exinfo'")


REGISTRY = [
    ("idx_a.xml", '<section name="Mail" path="D:\\mail" id="7" readonly="1"/>'),
    ("idx_b.xml", '<section name="archive" path="D:\\old" id="8" readonly="0"/>'),
    ("idx_c.xml", '<section name=" " path="D:\\x" id="9"/>'),
    ("idx_d.xml", "<section name="),
]


@query(o.golden("name, path, id, read_only, live, deleted", [("archive", "D:\\old", "8", False, 10, 2), ("Mail", "D:\\mail", "7", True, None, None)]))
def index_list(spark, sf_dir):
    """S13, F12, J12, O9; invalid registrations are left out, an unreadable store has no counts."""
    registered = S.registrations(rows(spark, "source string, xml string", REGISTRY))
    return P.listing(registered, rows(spark, "path string, live bigint, deleted bigint", [("D:\\old", 10, 2)]))


SETTINGS = [("a.xml", '<root><IdxParm><param name="depth" n="5"/><param name="mode">full</param></IdxParm></root>'), ("b.xml", "<root><Other/></root>")]


@query(o.golden("source, name, value", [("a.xml", "depth", "5"), ("a.xml", "mode", "full")]))
def index_settings(spark, sf_dir):
    """S12."""
    return S.settings(rows(spark, "source string, xml string", SETTINGS))


LABELS = [("d:\\OLD\\", "archive"), ("D:\\mail", "Mail"), ("D:/MAIL//", "MAIL"), ("E:\\new\\store\\", "store"), ("plain", "plain")]


@query(o.golden("path, label", LABELS))
def index_label(spark, sf_dir):
    """A store's registered name by its path, whatever its case and trailing separators; else the path's last part."""
    return S.labels(S.registrations(rows(spark, "source string, xml string", REGISTRY)), rows(spark, "path string", [(p,) for p, _ in LABELS]))


FOLDERS_XML = [(1, '<root><section name="OTHER"><ConfigFile>no</ConfigFile></section><section name="FOLDERS"><ConfigFile>$(ApplicationData)\\idx</ConfigFile></section></root>'), (2, '<root><section name="FOLDERS"><Else>x</Else></section></root>'), (3, "<root><section"), (4, None)]


@query(o.golden("id, pattern", [(1, "$(ApplicationData)\\idx"), (2, None), (3, None), (4, None)]))
def folder_patterns(spark, sf_dir):
    """Where registrations are kept, as the settings say."""
    return rows(spark, "id int, xml string", FOLDERS_XML).select("id", S.folder_pattern(F.col("xml")).alias("pattern"))


# ---- hierarchy ---------------------------------------------------------------------------------------------------

FOLDERS = "folder_id string, parent_id string, path string, doc_id bigint"
TWINS = [("c", "top", r"C:\Box", 2), ("in", "c", r"C:\box", 3), ("x", "in", r"C:\box\x", 4), ("top", None, "C:", 1), ("p", "q", "P:", 5), ("q", "p", "p:", 6), ("lone", None, "L:", 7), ("kid", "lone", "l:", 8)]


@query(o.golden("folder_id, node_id", [("c", "c"), ("in", "c"), ("x", "x"), ("top", "top"), ("p", "p"), ("q", "p"), ("lone", "lone"), ("kid", "lone")]))
def unify_same_path(spark, sf_dir):
    """H4: a container and its inside are one node; with no parent outside, the first."""
    return H.unify(rows(spark, FOLDERS, TWINS))


GRAFTS = [("r", "C:"), ("m", r"C:\mail"), ("deep", r"c:\MAIL\box.pst\inner\leaf"), ("near", r"C:\mail\b"), ("none", r"Q:\zz\y")]


@query(o.golden("node_id, host_id", [("m", "r"), ("deep", "m"), ("near", "m")]))
def longest_prefix_graft(spark, sf_dir):
    """The deepest existing path above."""
    nodes = rows(spark, "node_id string, path string", GRAFTS)
    return H.graft_hosts(nodes, nodes)


PLACES = [("C:\\a", True, "a", None, "own", "a"), ("C:\\a\\f", False, None, "a", "file", "a"), ("C:\\a\\d", True, None, "a", "empty", "a"), ("Z:\\lost", False, None, "gone", "orphan", None), ("<cycle>\\x", False, "a", None, "omitted", None)]


@query(o.golden("owner, place, node_id", [(x[0], x[4], x[5]) for x in PLACES]))
def attach_rows(spark, sf_dir):
    """H6, J7, F9."""
    cost_rows = rows(spark, "owner string, is_folder boolean, own_folder_id string, parent_folder_id string", [x[:4] for x in PLACES])
    return H.attach(cost_rows, rows(spark, "folder_id string, node_id string", [("a", "a")])).select("owner", "place", "node_id")


def _tree(spark, sf_dir):
    report = fx.texts_report(spark, sf_dir)
    return report, H.build_tree(H.folder_table(report.extra["store"]), report.rows)


@query(o.texts(r"""SELECT folder, subtree, exclusive, own, files, dirs, len(string_split(folder, '\')) - 1 AS depth FROM rolled"""))
def folder_rollup(spark, sf_dir):
    """H3, H7, A10, J8."""
    nodes = _tree(spark, sf_dir)[1].nodes
    return nodes.select(F.col("path").alias("folder"), F.col("subtree_bytes").alias("subtree"), F.col("subtree_exclusive").alias("exclusive"), F.col("own_bytes").alias("own"), "files", "dirs", F.col("depth").cast("bigint").alias("depth"))


@query(o.texts(r"SELECT subtree, exclusive, own, files, dirs, folder FROM rolled WHERE len(string_split(folder, '\')) <= 2 ORDER BY subtree DESC, folder LIMIT 4"))
def folder_ranking(spark, sf_dir):
    """O3, F8, H8."""
    return _tree(spark, sf_dir)[1].rank(4, depth=1)


@query(o.texts("SELECT home AS folder, sum(bytes)::BIGINT AS bytes FROM homes WHERE place = 'file' GROUP BY home"))
def direct_file_bytes(spark, sf_dir):
    """What the files of each folder itself cost."""
    return _tree(spark, sf_dir)[1].direct_files()


CONTAINERS = [("top", "root", "C:"), ("box", "top", "Box"), ("in", "box", ""), ("x", "in", "x"), ("loose", "root", "C:\\Box\\far"), ("lost", "root", "Q\\far")]


@query(o.golden("merged, grafted", [(1, 1)]))
def tree_counts(spark, sf_dir):
    """Containers merged with their inside, and loose roots hung below a deeper path."""
    folders = H.folders_of(rows(spark, "folder_id string, parent_id string, name string, doc_id bigint", [(*x, i) for i, x in enumerate(CONTAINERS)]))
    none = rows(spark, "owner string, is_folder boolean, own_folder_id string, parent_folder_id string, apportioned_bytes bigint, exclusive_bytes bigint", [])
    return H.build_tree(folders, none).counts()


# ---- treemap -----------------------------------------------------------------------------------------------------


def _pages(spark, sf_dir):
    """Pages as leaves below drive P: by host and path; their folders are implied."""
    pages = fx.table(spark, sf_dir, "pages")
    plain = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    segments = F.concat(F.array(F.lit("P:")), F.filter(F.split(plain, "/"), lambda x: x != ""), F.array(F.concat(F.lit("page-"), F.col("page_id").cast("string"))))
    size = F.octet_length("html").cast("bigint")
    return pages.select(F.lit("leaf").alias("kind"), segments.alias("segments"), size.alias("size"), size.alias("physical"), F.lit("").alias("attributes"), F.lit(None).cast("bigint").alias("ticks"))


@query(f"WITH {o.PAGE_SUMS} SELECT key AS path, depth, size, files FROM sums")
def path_trie_sums(spark, sf_dir):
    """H9, H12, A14, S16's inverse: prefix roll-up of paths."""
    nodes, _ = M.trie(_pages(spark, sf_dir))
    return nodes.select(F.array_join("key", "\\").alias("path"), F.size("key").cast("bigint").alias("depth"), F.col("sub_size").alias("size"), "files")


@query(f"WITH {o.PAGE_SUMS} SELECT count(*) AS implicit_folders FROM sums")
def implicit_folders(spark, sf_dir):
    """H16."""
    return M.treemap(_pages(spark, sf_dir), "Pages").implicit_folders()


@query(rf"WITH {o.PAGE_SUMS}, ranked AS (SELECT array_to_string(parts[1:len(parts) - 1], '\') AS folder, parts[len(parts)] AS name, size FROM leaves) SELECT folder || '\' || name AS path, row_number() OVER (PARTITION BY lower(folder) ORDER BY size DESC, name) AS place FROM ranked")
def emission_order(spark, sf_dir):
    """Files of a folder follow one another by size."""
    from pyspark.sql import Window as W

    made = M.treemap(_pages(spark, sf_dir), "Pages").rows.where(F.col(M.COLUMNS[7]) == "0x00000008")
    folder = F.lower(F.regexp_replace("Name", r"\\[^\\]*$", ""))
    return made.select(F.col("Name").alias("path"), F.row_number().over(W.partitionBy(folder).orderBy("order_key")).cast("bigint").alias("place"))


PARTS = [
    ("node", ["C:"], 0, 1, "", 5), ("node", ["C:", "Dir"], 10, 7, "", None), ("leaf", ["C:", "dir", "File"], 3, 2, "A", 9), ("leaf", ["c:", "Dir", "sub", "deep"], 4, 4, "", 1),
    ("leaf", ["C:", "Dir", "sub"], 5, 6, "", 2), ("empty", ["C:", "Bare"], 1, 1, "R", None), ("empty", ["C:", "Full"], 2, 2, "", None), ("leaf", ["C:", "Full", "x"], 1, 9, "", None),
]
DRIVE_ROWS = [
    ("000000000000", "C:\\", 7, 4, 26, 32), ("000000000000.010000000000", "C:\\Dir", 4, 1, 22, 19), ("000000000000.010000000000.010000000000", "C:\\Dir\\<folder entry>", 0, 0, 10, 7),
    ("000000000000.010000000000.020000000000", "C:\\Dir\\File", 0, 0, 3, 2), ("000000000000.010000000000.040000000000", "C:\\Dir\\sub", 2, 0, 9, 10), ("000000000000.010000000000.040000000000.010000000000", "C:\\Dir\\sub\\<folder entry>", 0, 0, 5, 6),
    ("000000000000.010000000000.040000000000.020000000000", "C:\\Dir\\sub\\deep", 0, 0, 4, 4), ("000000000000.010000000001", "C:\\Full", 2, 0, 3, 11), ("000000000000.010000000001.010000000000", "C:\\Full\\<folder entry>", 0, 0, 2, 2),
    ("000000000000.010000000001.020000000000", "C:\\Full\\x", 0, 0, 1, 9), ("000000000000.020000000000", "C:\\<folder entry>", 0, 0, 0, 1), ("000000000000.040000000000", "C:\\Bare", 0, 0, 1, 1),
]


@query(o.golden("order_key, name, files, folders, logical, physical", DRIVE_ROWS))
def trie_collisions(spark, sf_dir):
    """Case twins, a leaf that a folder shares its name with, own bytes that move to an entry."""
    made = M.treemap(rows(spark, M.KINDS, PARTS), "Root").rows
    return made.select("order_key", F.col("Name").alias("name"), F.col("Files").alias("files"), F.col("Folders").alias("folders"), F.col("Logical Size").alias("logical"), F.col("Physical Size").alias("physical"))


@query(o.treemap())
def treemap_rows(spark, sf_dir):
    """All rows of a treemap, by order_key."""
    return M.of_tree(_tree(spark, sf_dir)[1], "Texts").emitted()


@query(o.texts("SELECT (SELECT sum(bytes) FROM homes WHERE place <> 'omitted')::BIGINT AS physical, (SELECT count(*) FROM homes WHERE place = 'file') AS leaves, sum(actual)::BIGINT - (SELECT sum(bytes) FROM homes WHERE place <> 'omitted')::BIGINT AS omitted FROM checks"))
def treemap_closure(spark, sf_dir):
    """Root and omitted bytes are the store's."""
    report, tree = _tree(spark, sf_dir)
    made = M.of_tree(tree, "Texts")
    leaves = made.leaves.agg(F.count(F.lit(1)).alias("leaves"))
    left = M.omitted(tree, report.checks).agg(F.sum("bytes").cast("bigint").alias("omitted"))
    return made.root.select(F.col("Physical Size").alias("physical")).join(leaves).join(left)


# ---- validation --------------------------------------------------------------------------------------------------

SPLITS = [('"a",,b', "a||b"), ("a,b,", "a|b"), ('"a"x,b', "a||b"), ('"open,x', ""), ("", ""), ('"a""b",c', 'a|b"|c')]


@query(o.golden("line, fields", [(i + 1, w) for i, (x, w) in enumerate(SPLITS) if x]))
def split_lines(spark, sf_dir):
    """S16, Q20."""
    df = rows(spark, "line bigint, text string", [(i + 1, x) for i, (x, _) in enumerate(SPLITS)])
    return V.parse(df).select("line", F.array_join("fields", "|").alias("fields"))


HEAD = "Name,Files,Folders,Logical Size,Physical Size,Attributes,Last Change,WinDirStat Attributes,Index"
DIR, DRIVE, FILE, ROOT = "0x00000004", "0x00000002", "0x00000008", "0x10000001"


def _line(name, files, folders, size, kind):
    return f"{name},{files},{folders},{size},{size},,,{kind},0x0"


FAULTY = [
    "\ufeff" + HEAD, _line("C:\\", 1, 1, 5, DRIVE), _line("Root", 9, 9, 30, ROOT), _line("C:\\", 2, 2, 30, DRIVE), _line("C:\\a\\early", 0, 0, 1, FILE), _line("C:\\a", 2, 1, 20, DIR), _line("C:\\a\\f", 0, 0, 15, FILE), "",
    _line("C:\\A\\g", 0, 0, 5, FILE), _line("C:\\bare", 0, 0, 3, DIR), _line("C:\\bare\\x", 0, 0, 3, FILE), _line("Root\\y", 0, 0, 3, FILE), "short,1,2", _line("lost", 0, 0, 1, FILE), _line("C:\\a\\sub", 1, 0, 4, DIR), _line("C:\\a\\sub\\z", 0, 0, 4, FILE),
]


@query(o.golden("ok, data_rows, attached, dropped, root_logical, root_physical, child_sums, errors, warnings", [(False, 14, 7, 6, 30, 30, False, 1, 8)]))
def validator_summary(spark, sf_dir):
    """A17, A18, F11, J11, P25, U6, Q21-Q23."""
    return V.validate(rows(spark, "line bigint, text string", [(i + 1, x) for i, x in enumerate(FAULTY)]))[0]


@query(o.golden("line, severity, message", [
    (2, "warning", "drive 'C:\\' before any root"), (5, "warning", "parent 'C:\\a' was not defined earlier"), (9, "warning", "parent 'C:\\A' was not defined earlier"), (11, "warning", "parent 'C:\\bare' has no files and no folders"), (12, "error", "'Root\\y' hangs directly off the root"), (13, "warning", "too few fields"), (14, "warning", "parent '' was not defined earlier"),
    (None, "warning", "'C:\\': children sum to 23/23"), (None, "warning", "'C:\\a': children sum to 19/19"),
]))
def validator_findings(spark, sf_dir):
    """C9, Q23."""
    return V.reported(V.validate(rows(spark, "line bigint, text string", [(i + 1, x) for i, x in enumerate(FAULTY)]))[1])


@query(o.golden("line, severity, message", [(1, "error", "missing columns: Files, Index")]))
def validator_columns(spark, sf_dir):
    """A header that lacks columns."""
    lines = [HEAD.replace(",Files", "").replace(",Index", ""), "x,1"]
    return V.validate(rows(spark, "line bigint, text string", [(i + 1, x) for i, x in enumerate(lines)]))[1]


@query(o.texts("SELECT true AS ok, 0::BIGINT AS dropped, true AS child_sums, 0::BIGINT AS errors, 0::BIGINT AS warnings, (SELECT sum(bytes) FROM homes WHERE place <> 'omitted')::BIGINT AS root_physical"))
def treemap_validates(spark, sf_dir):
    """Our own treemap loads without a drop, and its sums hold."""
    from pyspark.sql import Window as W

    made = M.of_tree(_tree(spark, sf_dir)[1], "Texts").emitted()
    numbered = made.select((F.row_number().over(W.orderBy("order_key")) + 1).cast("bigint").alias("line"), T.csv_line([F.col(f"`{c}`") for c in M.COLUMNS]).alias("text"))
    head = rows(spark, "line bigint, text string", [(1, ",".join(M.COLUMNS))])
    return V.validate(head.unionByName(numbered))[0].select("ok", "dropped", "child_sums", "errors", "warnings", "root_physical")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: index cost by source, to the byte."""
    store = fx.texts_store(spark, sf_dir)
    postings = C.posting_costs(store)
    by_doc = C.document_costs(postings, C.term_entries(postings))
    of = store.docs.select("segment", "doc", F.regexp_extract(first("id"), "^f-(.*):", 1).alias("folder")).where("folder <> ''")
    rows_ = of.join(by_doc, ["segment", "doc"]).groupBy("folder").agg(F.count(F.lit(1)).alias("docs"), *(F.sum(c).cast("bigint").alias(c) for c in C.COUNTERS[2:]))
    return rows_.orderBy(F.desc("position_bytes"), "folder").limit(20)


__all__ = ["ORACLES", "QUERIES", "Store", "entry"]
