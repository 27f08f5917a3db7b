"""What every document and owner costs an index, to the byte, and whether the books balance."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bytemodel as B
from ..functions.decode import decimal_number, ticks
from ..functions.text import fold, is_synthetic, item_folder_id, item_key_name, join_path
from ..plans.shared import written
from ..sources.store import Store, first, is_folder_evidence
from .hierarchy import folder_paths, folder_table
from .windows import descending_block, in_order, running_sum

# ---- fixed values: owners that are no file, and the lines of the reconciliation ----
INDEX_OWNER = "<index metadata>"
UNKNOWN_OWNER = "<unattributed>"
DELETED_OWNER = "<deleted documents - reclaimed on optimise>"
CHECKS = [".prx  positions", ".frq  postings", ".fdt+.fdx stored", ".nrm  norms", ".tis  dictionary", ".tii  dict index", ".fnm  field infos"]

TERM = ["segment", "field", "term"]
#: Documents, or leading characters of a term, to a block of the two-level windows.
DOC_BLOCK, TERM_BLOCK = 1 << 16, 3


def posting_costs(store: Store) -> DataFrame:
    """segment, field, field_no, term, block, doc, rank, freq_bytes, prox_bytes of every posting, deleted documents' too.

    Positions are costed where they are read, so that they are not shuffled; then postings are dealt once, by term and block.
    """
    infos = store.field_infos.select("segment", "field", F.col("number").alias("field_no"), "has_freqs", "has_positions", "has_payloads")
    prox = F.when(F.col("has_positions"), F.when(F.col("has_payloads"), B.positions(F.col("positions"), F.col("payloads"))).otherwise(B.positions(F.col("positions")))).otherwise(0)
    # a row a segment and field
    narrow = store.postings.join(F.broadcast(infos), ["segment", "field"]).select(*TERM, "field_no", "doc", "freq", "has_freqs", prox.alias("prox_bytes"), F.floor(F.col("doc") / DOC_BLOCK).alias("block"))
    # a scan of one column: if all documents are of one block, so is every posting list
    most = store.postings.agg(F.max("doc")).first()[0]
    rows = in_order(narrow, TERM, F.col("block"), ["doc"], "rank", {"doc": "before"}, single=most is None or most < DOC_BLOCK)
    delta = (F.col("doc") - F.coalesce("before", F.lit(0))).cast("bigint")
    return rows.select(*TERM, "field_no", "block", "doc", "rank", B.posting(delta, F.col("freq"), F.col("has_freqs")).alias("freq_bytes"), "prox_bytes")


def term_entries(postings: DataFrame) -> DataFrame:
    """segment, field, term, df, entry_bytes, skip_entries, last_block: the dictionary, terms in byte order within a field."""
    terms = written(postings.groupBy(*TERM, "field_no").agg(F.count(F.lit(1)).alias("df"), F.sum("freq_bytes").alias("frq"), F.sum("prox_bytes").alias("prx"), F.max("block").alias("last_block")))
    rows = in_order(terms, ["segment", "field"], F.left("term", F.lit(TERM_BLOCK)), ["term"], None, {"term": "prev", "frq": "prev_frq", "prx": "prev_prx"})
    prefix = B.shared_prefix(F.coalesce("prev", F.lit("")), F.col("term"))
    size = F.octet_length("term").cast("bigint")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    entry = B.term_entry(prefix, size - prefix, F.col("field_no").cast("bigint"), F.col("df"), zero("prev_frq"), zero("prev_prx"))
    return rows.select(*TERM, "df", entry.alias("entry_bytes"), B.skip_entries(F.col("df")).alias("skip_entries"), "last_block")


def document_costs(postings: DataFrame, entries: DataFrame) -> DataFrame:
    """segment, doc and the sums of its postings: posting, position, sole and shared bytes, share and count of shared terms.

    An entry goes to each block of its term, so a term that every document has is met in as many tasks as it has blocks.
    """
    blocks = entries.select(*TERM, "df", "entry_bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last_block"))).alias("block"))
    rows = postings.join(blocks, [*TERM, "block"])
    sole = F.col("df") == 1
    entry = F.col("entry_bytes")
    total = lambda x, name: F.sum(x).cast("bigint").alias(name)
    return rows.groupBy("segment", "doc").agg(
        total("freq_bytes", "posting_bytes"),
        total("prox_bytes", "position_bytes"),
        total(F.when(sole, entry).otherwise(0), "sole_term_bytes"),
        total(F.when(~sole, entry).otherwise(0), "shared_term_bytes"),
        total(F.when(~sole, 1).otherwise(0), "shared_term_count"),
        total(F.when(~sole, B.apportion(entry, F.col("df"), F.col("rank"))).otherwise(0), "shared_share"),
    )


COUNTERS = ["stored_bytes", "norm_bytes", "posting_bytes", "position_bytes", "sole_term_bytes", "shared_term_bytes", "shared_term_count", "shared_share"]


def owners(store: Store) -> DataFrame:
    """segment, doc, doc_id, owner and what an owner's row takes from its documents."""
    docs = store.kinds()
    key = F.when(F.col("kind") == "folder", first("fldrid")).when(F.col("kind") == "item", first("id")).when(F.col("kind") == "meta", first("mid")).otherwise("")
    docs = docs.select("segment", "doc", "doc_id", "kind", F.coalesce(key, F.lit("")).alias("key"), first("name").alias("name"), is_folder_evidence().alias("is_folder"), decimal_number(first("sizenr")).alias("file_size"), ticks(first("modft")).alias("ticks"), first("attrx").alias("attributes"))
    paths = folder_paths(folder_table(store))
    # keys name a document whatever their case; the last real name of an item wins
    named = docs.where("kind = 'item' and name <> ''").groupBy(fold(F.col("key")).alias("fold_key")).agg(F.max_by("name", "doc_id").alias("real_name"))
    rows = docs.withColumn("folder_id", F.when(F.col("kind") == "folder", F.col("key")).when(F.col("kind").isin("item", "meta"), item_folder_id(F.col("key"))))
    rows = rows.join(paths.select("folder_id", "path"), "folder_id", "left").withColumn("fold_key", F.when(F.col("kind").isin("item", "meta"), fold(F.col("key"))))
    rows = rows.join(named, "fold_key", "left")
    unknown = F.when(F.col("folder_id") == "", "").otherwise(F.concat(F.lit("<unresolved:"), F.col("folder_id"), F.lit(">")))
    path = F.coalesce("path", unknown)
    name = F.coalesce("real_name", item_key_name(F.col("key")))
    owner = F.when(F.col("kind") == "deleted", DELETED_OWNER).when(F.col("kind") == "index", INDEX_OWNER).when(F.col("kind") == "other", UNKNOWN_OWNER).when(F.col("kind") == "folder", path).otherwise(join_path(path, name))
    live = F.col("kind") != "deleted"
    own = F.when(F.col("kind") == "folder", F.col("key"))
    parent = F.when(F.col("kind").isin("item", "meta"), F.col("folder_id"))
    return rows.select("segment", "doc", "doc_id", owner.alias("owner"), *(F.when(live, F.col(c)).alias(c) for c in ("is_folder", "file_size", "ticks", "attributes")), F.nullif(own, F.lit("")).alias("own_folder_id"), F.nullif(parent, F.lit("")).alias("parent_folder_id"))


@dataclass
class CostReport:
    """rows: one per owner. checks: one per kind of file. totals: one row of sums."""

    rows: DataFrame
    checks: DataFrame
    totals: DataFrame
    extra: dict = field(default_factory=dict)

    def csv_rows(self) -> DataFrame:
        """The columns of the report file."""
        return self.rows.select(F.col("owner").alias("Owner"), F.col("is_folder").alias("IsFolder"), F.col("doc_count").alias("Docs"), F.col("exclusive_bytes").alias("ExclusiveBytes"), F.col("stored_bytes").alias("StoredBytes"), F.col("norm_bytes").alias("NormBytes"), F.col("posting_bytes").alias("PostingBytes"), F.col("position_bytes").alias("PositionBytes"), F.col("sole_term_bytes").alias("SoleTermBytes"), F.col("shared_term_bytes").alias("SharedTermBytes"), F.col("shared_term_count").alias("SharedTermCount"))

    def files(self) -> DataFrame:
        """Owners that are files."""
        return self.rows.where(~F.col("is_folder") & ~is_synthetic(F.col("owner")))

    def top_files(self, n: int = 15) -> DataFrame:
        return self.files().orderBy(F.desc("exclusive_bytes"), "first_doc").limit(n).select(F.col("exclusive_bytes").alias("exclusive"), F.col("position_bytes").alias("positions"), F.col("posting_bytes").alias("postings"), F.col("stored_bytes").alias("stored"), F.col("sole_term_bytes").alias("sole_terms"), F.col("shared_term_bytes").alias("shared"), F.col("owner").alias("file"))

    def pareto(self, tenths: int = 9) -> DataFrame:
        """How many of the costliest files hold `tenths` tenths of the files' exclusive bytes."""
        files = self.files().select("owner", "first_doc", "exclusive_bytes")
        total = files.agg(F.coalesce(F.sum("exclusive_bytes"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("files"))
        run = running_sum(files, descending_block(F.col("exclusive_bytes")), [F.desc("exclusive_bytes"), F.col("first_doc")], "exclusive_bytes", "cum", "rank")
        reached = run.join(F.broadcast(total)).where(F.col("cum") * 10 >= F.col("total") * tenths).groupBy("total", "files").agg(F.min("rank").alias("top_files"))
        return reached.select(F.col("top_files").cast("bigint").alias("top_files"), F.col("files").cast("bigint").alias("files"), F.col("total").cast("bigint").alias("exclusive"), F.round(F.col("top_files") * 100.0 / F.col("files"), 1).alias("percent"))

    def closure(self) -> DataFrame:
        """exclusive + shared + unattributed = actual."""
        checks = self.checks.agg(F.sum("actual").alias("actual"), F.sum("computed").alias("computed"))
        exclusive = self.rows.agg(F.sum("exclusive_bytes").alias("exclusive"))
        row = checks.join(exclusive).join(self.totals.select("shared_dictionary"))
        share = lambda c: F.round(c * 100.0 / F.col("actual"), 1)
        left = F.col("actual") - F.col("computed")
        accounted = F.col("exclusive") + F.col("shared_dictionary") + left
        return row.select(*(F.col(c).cast("bigint").alias(n) for c, n in (("exclusive", "exclusive"), ("shared_dictionary", "shared"))), left.cast("bigint").alias("unattributed"), F.col("actual").cast("bigint").alias("actual"), share(F.col("exclusive")).alias("exclusive_pct"), share(F.col("shared_dictionary")).alias("shared_pct"), share(left).alias("unattributed_pct"), (F.col("actual") - accounted).cast("bigint").alias("off_by"))

    def dictionary_split(self) -> DataFrame:
        """Sole and shared dictionary bytes, the flat cost of a file's two documents, and bytes a skip entry."""
        frq = self.checks.where(F.col("check").startswith(".frq")).select((F.col("actual") - F.col("computed")).alias("residual"))
        row = self.totals.join(frq)
        per = F.when(F.col("skip_entries") > 0, F.round(F.col("residual") / F.col("skip_entries"), 3)).otherwise(0.0)
        return row.select("sole_dictionary", "shared_dictionary", F.col("norm_fields").cast("bigint").alias("norm_fields"), (2 * (8 + F.col("norm_fields"))).cast("bigint").alias("flat_cost"), "skip_entries", per.alias("skip_bytes_per_entry"))

    def overview(self) -> DataFrame:
        """One row: what was computed of each kind, and the store's size, documents and fields with norms."""
        sums = self.rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTERS[:4]))
        return sums.join(self.totals).select(*COUNTERS[:4], "sole_dictionary", "shared_dictionary", "skip_entries", F.col("norm_fields").cast("bigint").alias("norm_fields"), "has_payloads", F.col("max_doc").cast("bigint").alias("max_doc"), "store_bytes")

    def explained(self) -> DataFrame:
        """The checks with what each residual is."""
        return self.checks.select("check", "actual", "computed", (F.col("actual") - F.col("computed")).alias("residual"), explain().alias("class"))


def explain() -> Column:
    residual = F.col("actual") - F.col("computed")
    name = F.col("check")
    out = F.when(residual == 0, "exact").when((F.col("computed") == 0) & (F.col("actual") > 0), "index-wide").when(residual < 0, "over-counted")
    return out.when(name.startswith(".frq"), "skip lists").when(name.startswith(".tis"), "header and skip pointers").when(name.startswith(".fdt") | name.startswith(".nrm"), "segment headers").otherwise("percent")


def cost(store: Store) -> CostReport:
    """The whole analysis: documents, owners, reconciliation."""
    # each is read more than once: computed once, kept where executors can be lost
    postings = written(posting_costs(store))
    entries = written(term_entries(postings))
    by_doc = document_costs(postings, entries)
    norms = store.field_infos.where("is_indexed and has_norms").groupBy("segment").agg(F.count(F.lit(1)).alias("norm_bytes"))
    docs = owners(store).join(store.stored_bytes(), ["segment", "doc"]).join(norms, "segment", "left").join(by_doc, ["segment", "doc"], "left")
    docs = docs.fillna(0, [c for c in COUNTERS])
    least = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("doc_id"))).alias(c)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("doc_id"))).alias(c)
    rows = docs.groupBy(fold(F.col("owner")).alias("owner_key")).agg(
        F.min_by("owner", "doc_id").alias("owner"),
        F.coalesce(F.bool_or("is_folder"), F.lit(False)).alias("is_folder"),
        F.count(F.lit(1)).alias("doc_count"),
        *(F.sum(c).cast("bigint").alias(c) for c in COUNTERS),
        F.coalesce(F.sum("file_size"), F.lit(0)).cast("bigint").alias("file_size"),
        least("ticks"),
        least("attributes"),
        last("own_folder_id"),
        last("parent_folder_id"),
        F.min("doc_id").alias("first_doc"),
    )
    exclusive = sum((F.col(c) for c in COUNTERS[1:5]), F.col(COUNTERS[0]))
    rows = rows.withColumn("exclusive_bytes", exclusive).withColumn("apportioned_bytes", exclusive + F.col("shared_share"))
    shared = F.col("df") > 1
    dictionary = entries.agg(F.coalesce(F.sum(F.when(~shared, F.col("entry_bytes"))), F.lit(0)).cast("bigint").alias("sole_dictionary"), F.coalesce(F.sum(F.when(shared, F.col("entry_bytes"))), F.lit(0)).cast("bigint").alias("shared_dictionary"), F.coalesce(F.sum("skip_entries"), F.lit(0)).cast("bigint").alias("skip_entries"))
    most = norms.agg(F.coalesce(F.max("norm_bytes"), F.lit(0)).alias("norm_fields"))
    payloads = store.field_infos.agg(F.coalesce(F.bool_or("has_payloads"), F.lit(False)).alias("has_payloads"))
    totals = dictionary.join(most).join(payloads).join(store.counts().select("max_doc")).join(store.total_bytes())
    return CostReport(rows, reconcile(store, rows, totals), totals, {"postings": postings, "entries": entries, "documents": docs})


def reconcile(store: Store, rows: DataFrame, totals: DataFrame) -> DataFrame:
    """check, actual, computed: seven rows."""
    computed = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS)).join(totals)
    sums = computed.select("position_bytes", "posting_bytes", "stored_bytes", "norm_bytes", (F.col("sole_dictionary") + F.col("shared_dictionary")).alias("dictionary"), F.lit(0).alias("zero"))
    lines = [(CHECKS[0], "position_bytes"), (CHECKS[1], "posting_bytes"), (CHECKS[2], "stored_bytes"), (CHECKS[3], "norm_bytes"), (CHECKS[4], "dictionary"), (CHECKS[5], "zero"), (CHECKS[6], "zero")]
    listed = sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(c).cast("bigint").alias("computed")) for n, c in lines))).alias("x")).select("x.*")
    ext = F.substring("ext", 1, 4)
    actual = store.bytes_by_extension().select(F.when(ext == ".fdx", ".fdt").otherwise(ext).alias("ext"), "actual").groupBy("ext").agg(F.sum("actual").alias("actual"))
    return listed.join(actual, F.substring("check", 1, 4) == F.col("ext"), "left").select("check", F.coalesce("actual", F.lit(0)).cast("bigint").alias("actual"), "computed")
