"""Folder trees given by parent ids: paths, repair, roll-up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SEP, fold, is_real_root, is_synthetic, normalize_root, split_path
from ..plans.shared import written, written_counting
from ..sources.store import Store, first

CYCLE = "<cycle>"


def folder_table(store: Store) -> DataFrame:
    """folder_id, parent_id, name, doc_id of the live folder documents; the last document of an id counts."""
    return folders_of(store.of_kind("folder").select(first("fldrid").alias("folder_id"), first("fldrpid").alias("parent_id"), first("fldrnm").alias("name"), "doc_id"))


def folders_of(rows: DataFrame) -> DataFrame:
    last = rows.where("folder_id <> ''").groupBy("folder_id").agg(F.max_by(F.struct("parent_id", "name"), "doc_id").alias("x"), F.min("doc_id").alias("doc_id"))
    parent = F.when(F.lower("x.parent_id") != "root", F.nullif("x.parent_id", F.lit("")))
    return last.select("folder_id", parent.alias("parent_id"), normalize_root(F.coalesce("x.name", F.lit(""))).alias("name"), "doc_id")


def chains(nodes: DataFrame, id: str, parent: str, value: Column) -> DataFrame:
    """id, chain, up: for every node the values of itself and its ancestors, nearest first.

    Chains double in length each round, so a tree of depth d takes log2(d) joins. up is null where the chain is
    whole, the missing id where a parent does not exist, and the node's own id where the walk goes round.
    """
    known = nodes.select(F.col(id).alias("_p"), F.lit(True).alias("_known")).distinct()
    state = nodes.select(F.col(id).alias("id"), F.array(value).alias("chain"), F.col(parent).alias("_p")).join(known, "_p", "left")
    state, left = written_counting(state.select("id", "chain", F.when(F.col("_known"), F.col("_p")).alias("up"), F.when(F.col("_known").isNull(), F.col("_p")).alias("missing")), "up is not null")
    while left:
        higher = state.select(F.col("id").alias("up"), F.col("chain").alias("_c"), F.col("up").alias("_u"), F.col("missing").alias("_m"))
        going = state.where("up is not null").drop("missing").join(higher, "up").select("id", F.concat("chain", "_c").alias("chain"), F.col("_u").alias("up"), F.col("_m").alias("missing"))
        state, now = written_counting(state.where("up is null").unionByName(going), "up is not null")
        if now == left:  # each round settles at least one node that does not lead into a cycle
            break
        left = now
    whole = state.where("up is null").select("id", "chain", F.col("missing").alias("up"))
    if not left:
        return whole
    round_ = state.where("up is not null").select("id")
    links = nodes.select(F.col(id).alias("at"), F.col(parent).alias("next"), value.alias("v"))
    walk = round_.select("id", F.col("id").alias("at"), F.array().cast("array<string>").alias("seen")).withColumn("chain", F.array().cast(state.schema["chain"].dataType))
    done = None
    while True:
        step = walk.join(links, "at").select("id", F.col("next").alias("at"), F.array_append("seen", F.col("at").cast("string")).alias("seen"), F.array_append("chain", F.col("v")).alias("chain"))
        step = written(step)
        met = F.array_contains("seen", F.col("at").cast("string"))
        closed = step.where(met).select("id", "chain", F.col("id").alias("up"))
        done = closed if done is None else done.unionByName(closed)
        walk = step.where(~met)
        if walk.isEmpty():
            return whole.unionByName(done)


def folder_paths(folders: DataFrame) -> DataFrame:
    """folder_id, path: names from the root down; a missing parent or a cycle is marked in front. Empty names are left out."""
    named = chains(folders, "folder_id", "parent_id", F.struct(F.col("folder_id").alias("i"), F.col("name").alias("n")))
    names = F.filter(F.reverse(F.transform("chain", lambda x: x["n"])), lambda n: n != "")
    mark = F.when(F.col("up") == F.col("id"), F.lit(CYCLE)).when(F.col("up").isNotNull(), F.concat(F.lit("<unresolved:"), "up", F.lit(">")))
    parts = F.when(mark.isNotNull(), F.concat(F.array(mark), names)).otherwise(names)
    # a root name that ends in a separator takes no second one
    path = F.aggregate(parts, F.lit(""), lambda a, n: F.when(a == "", n).when(F.endswith(a, F.lit(SEP)), F.concat(a, n)).otherwise(F.concat(a, F.lit(SEP), n)))
    return named.select(F.col("id").alias("folder_id"), path.alias("path"))


def unify(nodes: DataFrame) -> DataFrame:
    """folder_id, node_id: ids whose paths are one, whatever their case, share a node.

    The node is a member whose parent lies outside the group, else a parentless one, else the first in scan order.
    nodes: folder_id, parent_id, path, doc_id.
    """
    key = fold(F.col("path"))
    parents = nodes.select(F.col("folder_id").alias("parent_id"), key.alias("parent_key"))
    judged = nodes.join(parents, "parent_id", "left").withColumn("key", key)
    rank = F.when(F.col("parent_key").isNotNull() & (F.col("parent_key") != F.col("key")), 0).when(F.col("parent_id").isNull(), 1).otherwise(2)
    chosen = judged.groupBy("key").agg(F.min(F.struct(rank.alias("r"), F.col("doc_id"), F.col("folder_id"))).alias("x")).select("key", F.col("x.folder_id").alias("node_id"))
    return judged.join(chosen, "key").select("folder_id", "node_id")


def proper_prefixes(path: Column) -> Column:
    """The paths above a path, from the nearest."""
    parts = split_path(path)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.size(parts) - 1, F.lit(1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), SEP)))


def graft_hosts(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """node_id, host_id: the deepest of the known paths above each node's path. Both: node_id, path."""
    above = nodes.select("node_id", F.explode(proper_prefixes(F.col("path"))).alias("prefix"))
    by_key = known.select(fold(F.col("path")).alias("key"), F.col("node_id").alias("host_id"))
    met = above.join(by_key, fold(F.col("prefix")) == F.col("key")).where("node_id <> host_id")
    return met.groupBy("node_id").agg(F.max_by("host_id", F.length("prefix")).alias("host_id"))


@dataclass
class CostTree:
    """nodes: node_id, parent_id, path, depth, aliases, and bytes and counts of its own and of its subtree.
    ids: folder_id, node_id. placed: cost rows with node_id and how they stand (own, file, empty, orphan, omitted)."""

    nodes: DataFrame
    ids: DataFrame
    placed: DataFrame
    above: DataFrame

    def roots(self) -> DataFrame:
        return self.nodes.where("parent_id is null")

    def orphans(self) -> DataFrame:
        return self.placed.where("place = 'orphan'")

    def cycles(self) -> DataFrame:
        return self.nodes.where(F.col("path").startswith(CYCLE))

    def counts(self) -> DataFrame:
        """merged (ids that share a node with another), grafted (parentless nodes hung below a deeper path)."""
        return self.nodes.agg(F.coalesce(F.sum("aliases"), F.lit(0)).cast("bigint").alias("merged"), F.count_if("grafted").alias("grafted"))

    def direct_files(self) -> DataFrame:
        """folder, bytes: of the files that lie in a folder itself."""
        direct = self.placed.where("place = 'file'").groupBy("node_id").agg(F.sum("apportioned_bytes").cast("bigint").alias("bytes"))
        return self.nodes.join(direct, "node_id").select(F.col("path").alias("folder"), "bytes")

    def rank(self, n: int = 15, depth: int = 0) -> DataFrame:
        """The costliest folders; down to a depth, if that is above 0."""
        rows = self.nodes.where(F.col("depth") <= depth) if depth > 0 else self.nodes
        return rows.orderBy(F.desc("subtree_bytes"), "path", "node_id").limit(n).select(F.col("subtree_bytes").alias("subtree"), F.col("subtree_exclusive").alias("exclusive"), F.col("own_bytes").alias("own"), "files", "dirs", F.col("path").alias("folder"))


def build_tree(folders: DataFrame, cost_rows: DataFrame) -> CostTree:
    """Unify, graft, attach, roll up. folders: folder_table(); cost_rows: CostReport.rows."""
    paths = written(folders.join(folder_paths(folders), "folder_id"))
    ids = written(unify(paths))
    owner_of = ids.select(F.col("folder_id").alias("parent_id"), F.col("node_id").alias("parent_node"))
    base = paths.join(ids.where("folder_id = node_id").select("folder_id", "node_id"), "folder_id").join(owner_of, "parent_id", "left")
    base = base.select("node_id", "path", F.when(F.col("parent_node") != F.col("node_id"), F.col("parent_node")).alias("parent_id"))
    loose = base.where(F.col("parent_id").isNull() & ~is_real_root(F.col("path")))
    hosts = graft_hosts(loose, base)
    base = written(base.join(hosts, "node_id", "left").select("node_id", "path", F.coalesce("parent_id", "host_id").alias("parent_id"), F.col("host_id").isNotNull().alias("grafted")))
    merged = ids.groupBy("node_id").agg((F.count(F.lit(1)) - 1).alias("aliases"))

    placed = attach(cost_rows, ids)
    whole = lambda x, name: F.coalesce(F.sum(x), F.lit(0)).cast("bigint").alias(name)
    is_ = lambda p: F.col("place") == p
    own = placed.where("node_id is not null").groupBy("node_id").agg(
        whole(F.when(is_("own"), F.col("apportioned_bytes")), "own_bytes"),
        whole("apportioned_bytes", "bytes"),
        whole("exclusive_bytes", "exclusive"),
        whole(is_("file").cast("int"), "own_files"),
        whole(is_("empty").cast("int"), "empties"),
    )
    closure = chains(base, "node_id", "parent_id", F.col("node_id"))
    # a node of a cycle hangs below no root: it has no totals
    closure = written(closure.where("up is null").select(F.col("id").alias("node_id"), F.col("chain").alias("above")))
    spread = base.select("node_id").join(own, "node_id", "left").join(closure, "node_id").select(F.posexplode("above").alias("distance", "ancestor"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("bytes", "exclusive", "own_files", "empties")))
    total = spread.groupBy(F.col("ancestor").alias("node_id")).agg(whole("bytes", "subtree_bytes"), whole("exclusive", "subtree_exclusive"), whole("own_files", "files"), whole(F.col("empties") + (F.col("distance") > 0).cast("int"), "dirs"))
    nodes = base.join(merged, "node_id").join(own.select("node_id", "own_bytes"), "node_id", "left").join(total, "node_id", "left").join(closure.select("node_id", (F.size("above") - 1).alias("depth")), "node_id", "left")
    nodes = nodes.fillna(0, ["own_bytes", "subtree_bytes", "subtree_exclusive", "files", "dirs", "depth"])
    return CostTree(nodes, ids, placed, closure)


def attach(cost_rows: DataFrame, ids: DataFrame) -> DataFrame:
    """cost rows with node_id and place: own (its folder's node), file or empty (below its parent's), orphan, omitted (synthetic)."""
    by = lambda c, n: ids.select(F.col("folder_id").alias(c), F.col("node_id").alias(n))
    rows = cost_rows.join(by("own_folder_id", "_own"), "own_folder_id", "left").join(by("parent_folder_id", "_parent"), "parent_folder_id", "left")
    place = F.when(is_synthetic(F.col("owner")), "omitted").when(F.col("_own").isNotNull(), "own").when(F.col("_parent").isNotNull(), F.when(F.col("is_folder"), "empty").otherwise("file")).otherwise("orphan")
    node = F.when(is_synthetic(F.col("owner")), F.lit(None)).otherwise(F.coalesce("_own", "_parent"))
    return rows.withColumn("place", place).withColumn("node_id", node).drop("_own", "_parent")
