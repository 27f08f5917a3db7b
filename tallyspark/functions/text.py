"""Paths, names and report texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\\"


def fold(x: Column) -> Column:
    """The key under which texts that differ in case are one."""
    return F.lower(x)


def item_folder_id(id: Column) -> Column:
    """The part before the first colon; empty without one."""
    at = F.locate(":", id)
    return F.when(at > 0, F.substr(id, F.lit(1), at - 1)).otherwise("")


def item_key_name(id: Column) -> Column:
    at = F.locate(":", id)
    return F.when(at > 0, F.substr(id, at + 1)).otherwise(F.coalesce(id, F.lit("")))


def display_name(name: Column, id: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), item_key_name(id))


def extension(name: Column) -> Column:
    """After the last dot, without it; empty for none or a trailing one."""
    return F.regexp_extract(name, r"\.([^.\\/]+)$", 1)


def raw_value(item: Column, meta: Column, separator: str = "|") -> Column:
    """All values of the item, else of the meta record, joined; null if neither has any."""
    has = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
    return F.array_join(F.when(has(item), item).when(has(meta), meta), separator)


def normalize_root(path: Column) -> Column:
    """Without the long-path prefix; its UNC form becomes a plain UNC path."""
    unc, long = "\\\\?\\UNC\\", "\\\\?\\"
    return F.when(F.upper(F.left(path, F.lit(len(unc)))) == unc, F.concat(F.lit("\\\\"), F.substr(path, F.lit(len(unc) + 1)))).when(F.startswith(path, F.lit(long)), F.substr(path, F.lit(len(long) + 1))).otherwise(path)


def join_path(head: Column, tail: Column) -> Column:
    """Two parts with one separator between them; an empty part leaves the other."""
    return F.when(F.coalesce(head, F.lit("")) == "", tail).when(F.coalesce(tail, F.lit("")) == "", head).when(F.endswith(head, F.lit(SEP)), F.concat(head, tail)).otherwise(F.concat(head, F.lit(SEP), tail))


def split_path(path: Column) -> Column:
    """Segments, empty ones dropped; of a UNC path the server and share are one segment."""
    plain = F.filter(F.split(path, r"\\"), lambda x: x != "")
    unc = F.concat(F.array(F.concat(F.lit("\\\\"), F.array_join(F.slice(plain, 1, 2), SEP))), F.slice(plain, 3, F.greatest(F.size(plain) - 2, F.lit(0))))
    return F.when(F.startswith(path, F.lit("\\\\")) & (F.size(plain) > 0), unc).otherwise(plain)


def is_real_root(path: Column) -> Column:
    """A drive, a UNC path, or a marker."""
    return path.rlike("^.:$") | F.startswith(path, F.lit("\\\\")) | F.startswith(path, F.lit("<"))


def is_synthetic(owner: Column) -> Column:
    return F.startswith(owner, F.lit("<"))


def sanitize(name: Column) -> Column:
    return F.translate(name, '"\r\n', "'  ")


def is_safe(name: Column) -> Column:
    return ~F.contains(name, F.lit('"'))


def flat(text: Column, limit: int) -> Column:
    """Newlines as \\n, and no longer than limit, with an ellipsis."""
    one = F.regexp_replace(F.regexp_replace(text, "\r", ""), "\n", r"\\n")
    return F.when(F.length(one) > limit, F.concat(F.left(one, F.lit(limit)), F.lit("…"))).otherwise(one)


def shorten(path: Column, limit: int = 58) -> Column:
    """The end of a long path, after an ellipsis."""
    return F.when(F.length(path) > limit, F.concat(F.lit("…"), F.right(path, F.lit(limit - 1)))).otherwise(path)


def csv_field(value: Column, delimiter: str = ",") -> Column:
    """Quoted if it holds the delimiter, a quote or a line end, or has white space at an edge; null is nothing."""
    edge = value.rlike(r"^\s|\s$")
    must = F.contains(value, F.lit(delimiter)) | F.contains(value, F.lit('"')) | F.contains(value, F.lit("\r")) | F.contains(value, F.lit("\n")) | edge
    return F.coalesce(F.when(must, F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value), F.lit(""))


def csv_line(values: list[Column], delimiter: str = ",") -> Column:
    return F.concat_ws(delimiter, *(csv_field(v.cast("string"), delimiter) for v in values))
