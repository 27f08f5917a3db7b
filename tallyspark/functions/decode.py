"""Decoding of text-encoded fields as Column expressions. Bad input gives null, never a wrong value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: fields and their encodings ----
ENCODINGS = {
    "sizenr": "decimal",
    "itemtype": "decimal",
    "modft": "ticks",
    "createft": "ticks",
    "idxdt": "ticks",
    "moddt": "hexticks",
    "idxdtstr": "hexticks",
    "attrx": "attributes",
    "idxfl": "flags",
    "idxtrm": "hex",
    "exinfo": "hex",
}

# ---- fixed values: file attribute bits and names ----
ATTRIBUTES = {
    1: "ReadOnly",
    2: "Hidden",
    4: "System",
    16: "Directory",
    32: "Archive",
    64: "Device",
    128: "Normal",
    256: "Temporary",
    512: "SparseFile",
    1024: "ReparsePoint",
    2048: "Compressed",
    4096: "Offline",
    8192: "NotContentIndexed",
    16384: "Encrypted",
    32768: "IntegrityStream",
    131072: "NoScrubData",
}

# ---- fixed values: attribute letters of a treemap row, in their order ----
LETTERS = [(1, "R"), (2, "H"), (4, "S"), (32, "A"), (2048, "C"), (16384, "E"), (4096, "O"), (512, "Z")]

DIRECTORY = 16
TICKS_A_SECOND = 10_000_000
TICKS_A_DAY = 864_000_000_000
LAST_TICK = 2_650_467_743_999_999_999


def idiv(a: Column, b) -> Column:
    """Whole quotient, exact for all 64-bit numbers."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("bigint"))


def decimal_number(raw: Column) -> Column:
    return F.regexp_extract(raw, r"^\s*([+-]?[0-9]+)\s*$", 1).try_cast("bigint")


def hex_number(raw: Column) -> Column:
    """Up to 16 digits after leading zeros, as a signed 64-bit number; an 0x prefix is allowed."""
    digits = F.regexp_extract(raw, r"^\s*(?:0[xX])?0*([0-9a-fA-F]{1,16})\s*$", 1)
    return F.conv(F.nullif(digits, F.lit("")), 16, -10).try_cast("bigint")


def number(raw: Column, encoding: str | Column) -> Column:
    """A number by its field's encoding; null for text."""
    if isinstance(encoding, str):
        return decimal_number(raw) if encoding in ("decimal", "ticks") else hex_number(raw) if encoding != "text" else F.lit(None).cast("bigint")
    return F.when(encoding.isin("decimal", "ticks"), decimal_number(raw)).when(encoding != "text", hex_number(raw))


def ticks(raw: Column, encoding: str = "ticks") -> Column:
    """100 ns ticks since 1601 in UTC, null outside the range of dates."""
    return dated(number(raw, "hex" if encoding == "hexticks" else "decimal"))


def dated(n: Column) -> Column:
    """Ticks that are a date; null for others."""
    return F.when((n > 0) & (n <= LAST_TICK), n)


def _date(t: Column) -> Column:
    return F.date_format(F.date_add(F.lit("1601-01-01").cast("date"), idiv(t, TICKS_A_DAY).cast("int")), "yyyy-MM-dd")


def _clock(t: Column) -> Column:
    second = idiv(t % TICKS_A_DAY, TICKS_A_SECOND)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(two(idiv(second, 3600)), F.lit(":"), two(idiv(second % 3600, 60)), F.lit(":"), two(second % 60))


def timestamp_export(t: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss.fffffffZ; null gives the empty text. No session time zone enters."""
    text = F.concat(_date(t), F.lit(" "), _clock(t), F.lit("."), F.lpad((t % TICKS_A_SECOND).cast("string"), 7, "0"), F.lit("Z"))
    return F.coalesce(text, F.lit(""))


def timestamp_treemap(t: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ssZ, cut to seconds; null gives the empty text."""
    return F.coalesce(F.concat(_date(t), F.lit("T"), _clock(t), F.lit("Z")), F.lit(""))


def attribute_names(mask: Column) -> Column:
    """Names joined with a pipe; empty for null or 0; the number if a bit has no name."""
    known = sum(ATTRIBUTES)
    names = F.array_join(F.array_compact(F.array(*(F.when(mask.bitwiseAND(bit) != 0, F.lit(name)) for bit, name in ATTRIBUTES.items()))), "|")
    return F.when(mask.isNull() | (mask == 0), F.lit("")).when(mask.bitwiseAND(F.lit(~known).cast("bigint")) != 0, mask.cast("string")).otherwise(names)


def has_attribute(mask: Column, bit: int) -> Column:
    return F.coalesce(mask.bitwiseAND(bit) != 0, F.lit(False))


def attribute_letters(mask: Column) -> Column:
    return F.when(mask > 0, F.concat(*(F.when(mask.bitwiseAND(bit) != 0, F.lit(letter)).otherwise("") for bit, letter in LETTERS))).otherwise("")


def content_indexed(flags: Column) -> Column:
    """Y or N by bit 0; empty where flags are unknown (null or negative)."""
    return F.when(flags >= 0, F.when(flags.bitwiseAND(1) != 0, "Y").otherwise("N")).otherwise("")


def other_flag_bits(flags: Column) -> Column:
    """Names of the bits 1 to 62 that are set."""
    bits = F.filter(F.sequence(F.lit(1), F.lit(62)), lambda b: F.call_function("shiftright", flags, b).bitwiseAND(1) == 1)
    return F.when(flags >= 0, F.array_join(F.transform(bits, lambda b: F.concat(F.lit("bit"), b.cast("string"))), "|")).otherwise("")


def encoding_of(field: Column) -> Column:
    out = F.lit("text")
    for name, encoding in ENCODINGS.items():
        out = F.when(field == name, encoding).otherwise(out)
    return out


def decoded(raw: Column, encoding: Column) -> Column:
    """A value as a report shows it: by its encoding, the raw text where that gives nothing to say."""
    n = number(raw, encoding)
    t = F.when((n > 0) & (n <= LAST_TICK), n)
    flags = F.concat_ws(" ", F.when(n >= 0, F.when(n.bitwiseAND(1) != 0, "content-indexed").otherwise("name-only")), F.nullif(other_flag_bits(n), F.lit("")))
    out = F.when(encoding == "text", F.lit("")).when(encoding.isin("ticks", "hexticks"), timestamp_export(t))
    return out.when(encoding == "attributes", attribute_names(n)).when(encoding == "flags", flags).otherwise(F.coalesce(n.cast("string"), F.lit("")))


def is_folder_item(itemtype: Column, attrx: Column) -> Column:
    return F.coalesce(itemtype == "4", F.lit(False)) | has_attribute(hex_number(attrx), DIRECTORY)


def item_type_hex(kind: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.hex(kind.cast("bigint")), 8, "0"))


def index_hex() -> Column:
    return F.lit("0x" + "0" * 16)
