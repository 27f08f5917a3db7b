"""The byte-exact model of an inverted index's files, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .decode import idiv

SKIP_INTERVAL, SKIP_LEVELS = 16, 10


def vint(x: Column) -> Column:
    """Bytes of a variable-length number of seven bits a byte; a negative one takes ten."""
    out = F.when(x < 0, 10)
    for n in range(1, 9):
        out = out.when(x < 1 << 7 * n, n)
    return out.otherwise(9).cast("bigint")


def posting(delta: Column, freq: Column, has_freqs: Column) -> Column:
    """One posting: the document delta, and the frequency folded into it or after it."""
    once = (freq == 1).cast("bigint")
    return F.when(has_freqs, vint(delta * 2 + once) + F.when(freq == 1, 0).otherwise(vint(freq))).otherwise(vint(delta))


def position(delta: Column, has_payloads: Column, payload: Column, changed: Column) -> Column:
    """One position; with payloads its lowest bit says that the payload's length changed, and the length follows."""
    flag = changed.cast("bigint")
    return F.when(has_payloads, vint(delta * 2 + flag) + F.when(changed, vint(payload)).otherwise(0) + payload).otherwise(vint(delta))


def positions(at: Column, payloads: Column | None = None) -> Column:
    """All positions of a posting (arrays in order): deltas begin at 0 and stop at a negative position."""
    zero = F.lit(0).cast("bigint")
    total = lambda each: F.aggregate(each, zero, lambda a, x: a + x)
    negative = F.filter(F.sequence(F.lit(1), F.size(at)), lambda i: F.element_at(at, i) < 0)
    counted = F.when(F.array_min(at) >= 0, at).otherwise(F.slice(at, F.lit(1), F.coalesce(F.array_min(negative) - 1, F.size(at))))
    before = lambda a, i, start: F.when(i > 0, F.get(a, i - 1)).otherwise(F.lit(start))
    delta = lambda x, i: (x - before(at, i, 0)).cast("bigint")
    if payloads is not None:
        size = lambda i: F.get(payloads, i).cast("bigint")
        each = F.transform(counted, lambda x, i: position(delta(x, i), F.lit(True), size(i), size(i) != before(payloads, i, -1)))
        return F.when(F.size(at) > 0, total(each)).otherwise(zero)
    # most postings have one position, which needs no array
    only = F.get(at, F.lit(0)).cast("bigint")
    one = F.when(only >= 0, vint(only)).otherwise(zero)
    return F.when(F.size(at) == 1, one).when(F.size(at) > 1, total(F.transform(counted, lambda x, i: vint(delta(x, i))))).otherwise(zero)


def stored_value(field_no: Column, length: Column) -> Column:
    return vint(field_no) + 1 + vint(length) + length


def term_entry(prefix: Column, suffix: Column, field_no: Column, df: Column, prev_frq: Column, prev_prx: Column) -> Column:
    """A dictionary entry: shared prefix, suffix and its bytes, field, document frequency, pointers; one byte more beyond the skip interval."""
    skip = F.when(df > SKIP_INTERVAL, 1).otherwise(0)
    return vint(prefix) + vint(suffix) + suffix + vint(field_no) + vint(df) + vint(prev_frq) + vint(prev_prx) + skip


def skip_entries(df: Column) -> Column:
    """Entries of a posting list's skip levels: one for every 16**k postings, on at most ten levels."""
    # levels beyond the last have a quotient of 0
    each = [idiv(df, SKIP_INTERVAL**k) for k in range(1, SKIP_LEVELS + 1)]
    total = each[0]
    for x in each[1:]:
        total = total + x
    return F.when(df > SKIP_INTERVAL, total).otherwise(0).cast("bigint")


def shared_prefix(a: Column, b: Column) -> Column:
    """Common leading bytes of two texts."""
    # a byte a character, and between the two a character that is no byte
    raw = lambda x: F.decode(F.encode(x, "UTF-8"), "ISO-8859-1")
    both = F.concat(raw(a), F.lit("\u0100"), raw(b))
    return F.coalesce(F.length(F.regexp_extract(both, "(?s)^([^\u0100]*)[^\u0100]*+\u0100\\1", 1)), F.lit(0)).cast("bigint")


def apportion(total: Column, n: Column, rank: Column) -> Column:
    """The share of the rank-th (from 0) of n owners: whole, with the remainder on the first ones."""
    return idiv(total, n) + (rank < total % n).cast("bigint")
