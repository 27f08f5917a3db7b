"""URL rules by a sort-merge range join.

A host's labels are reversed and joined into a key ("com<1>example<1>www<1>"), so that a rule's host and all its
subdomains are the keys with one prefix: an interval. Rows are range-partitioned by key (and by id within one key,
so a hot host spreads) and sorted; rules are sorted likewise. A sweep over both keeps a stack of the rules whose
interval is open: they are nested, the innermost on top, and each tests the row's path by its own prefix.

The longest rule wins: the one with the longest host, then with the longest path. Rows that no rule fits get the
method's own verdict, `default`. Rules come in sorted chunks of at most `chunk` rows (the bound of each broadcast);
a further chunk is one more sweep over the same sorted rows, without a further shuffle.

A null url, or one without "://", has empty host and path and fits no rule. Repeated rows are judged alike; other
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import thrifty

SEP, ESCAPE = "\x01", "\x02"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels in reverse, each ended by SEP; a host that holds SEP itself has it escaped, so no label looks like two."""
    plain = F.replace(F.replace(host, F.lit(ESCAPE), F.lit(ESCAPE + "b")), F.lit(SEP), F.lit(ESCAPE + "a"))
    return F.concat(F.array_join(F.reverse(F.split(plain, "[.]")), SEP), F.lit(SEP))


def _sweep(rules):
    """One pass over sorted rows with a chunk of rules [(key, host, path, action)], sorted by key."""

    @thrifty
    def run(batches):
        import pyarrow as pa

        prefixes, stops = [], []
        for key, host, path, action in rules.value:
            if not prefixes or prefixes[-1] != key:
                prefixes.append(key)
                stops.append([])
            stops[-1].append((path, (len(key), len(path)), host + path, action))
        for own in stops:
            own.sort(key=lambda x: (-len(x[0]), x[3]))  # a rule stated twice: allow before block
        stack: list[int] = []
        at, last = 0, None
        for batch in batches:
            cols = batch.to_pydict()
            for i, (key, path) in enumerate(zip(cols["key"], cols["path"])):
                if key != last:
                    while stack and not key.startswith(prefixes[stack[-1]]):
                        stack.pop()
                    to = bisect_right(prefixes, key, lo=at)
                    stack += (j for j in range(at, to) if key.startswith(prefixes[j]))
                    at, last = to, key
                for j in reversed(stack):
                    fit = next((x for x in stops[j] if path.startswith(x[0])), None)
                    if fit:
                        if fit[1] > (cols["host_rank"][i], cols["path_rank"][i]):
                            (cols["host_rank"][i], cols["path_rank"][i]), cols["rule"][i], cols["verdict"][i] = fit[1:]
                        break
            yield pa.RecordBatch.from_pydict(cols, schema=batch.schema)

    return run


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", chunk: int = 100_000, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row; rules: (action, host, path), hosts in lower case."""
    spark = pages.sparkSession
    kind = dict(pages.dtypes)[id_col]
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    rows = rows.select("page_id", "host", "path", host_key(F.col("host")).alias("key"), F.lit(-1).alias("host_rank"), F.lit(-1).alias("path_rank"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    rows = rows.withColumn("salt", F.xxhash64("page_id", "path")).repartitionByRange("key", "salt").sortWithinPartitions("key").drop("salt")
    schema = f"page_id {kind}, host string, path string, key string, host_rank int, path_rank int, rule string, verdict string"

    held: list[tuple] = []

    def swept(rows):
        return rows.mapInArrow(_sweep(spark.sparkContext.broadcast(list(held))), schema)

    for r in rules.where("host <> ''").select(host_key(F.col("host")).alias("key"), "host", "path", "action").orderBy("key", "path", "action").toLocalIterator():
        held.append(tuple(r))
        if len(held) == chunk:
            rows = swept(rows)
            held.clear()
    if held:
        rows = swept(rows)
    return rows.select("page_id", "host", "path", "rule", "verdict")
