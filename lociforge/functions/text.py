"""Column expressions that write values as the format's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What string values escape, in order; the percent sign first.
ESCAPES = (("%", "%25"), (":", "%3A"), (";", "%3B"), ("=", "%3D"), (",", "%2C"), ("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def percent_encode(value: Column | str) -> Column:
    v = _col(value)
    for raw, code in ESCAPES:
        v = F.replace(v, F.lit(raw), F.lit(code))
    return v


def percent_encode_text(value: str) -> str:
    for raw, code in ESCAPES:
        value = value.replace(raw, code)
    return value


def format_float(value: Column | str) -> Column:
    """Shortest decimal text without an exponent and without a needless ``.0``; ``.`` for what isn't finite, null for null."""
    v = _col(value).cast("double")
    shown = v.cast("string")
    pattern = r"^(-?)(\d+)\.(\d+)(?:E(-?\d+))?$"
    part = lambda i: F.regexp_extract(shown, pattern, i)
    exponent = F.coalesce(F.nullif(part(4), F.lit("")).cast("int"), F.lit(0))
    fraction = F.when(part(3) == "0", "").otherwise(part(3))
    digits, point = F.concat(part(2), fraction), F.length(part(2)) + exponent
    n = F.length(digits)
    body = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n)))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
    )
    bare = F.when(body.contains("."), F.regexp_replace(body, r"\.?0+$", "")).otherwise(body)
    return F.when(v.isNull(), None).when(F.isnan(v) | (F.abs(v) == float("inf")), ".").otherwise(F.concat(part(1), bare))


def format_float_text(value: float) -> str:
    """The same on the driver."""
    import math

    import numpy as np

    return "." if not math.isfinite(value) else np.format_float_positional(value, trim="-")


def filter_text(filters: Column | str) -> Column:
    """``.`` for null, ``PASS`` for none, else joined by semicolons."""
    f = _col(filters)
    return F.when(f.isNull(), ".").when(F.size(f) == 0, "PASS").otherwise(F.array_join(f, ";"))


def or_dot(values: Column | str, separator: str) -> Column:
    v = _col(values)
    return F.when(v.isNull() | (F.size(v) == 0), ".").otherwise(F.array_join(v, separator))


def info_text(entries: Column | str) -> Column:
    """``KEY=value`` joined by semicolons, in order; a null value is a flag's bare key; ``.`` without entries. Entries are structs key, value."""
    e = _col(entries)
    items = F.transform(e, lambda x: F.when(x["value"].isNull(), x["key"]).otherwise(F.concat(x["key"], F.lit("="), x["value"])))
    return F.when(e.isNull() | (F.size(e) == 0), ".").otherwise(F.array_join(items, ";"))


def contig_line(id: Column | str, length: Column | str) -> Column:
    i, n = _col(id), _col(length)
    return F.concat(F.lit("##contig=<ID="), i, F.when(n.isNull(), "").otherwise(F.concat(F.lit(",length="), n.cast("string"))), F.lit(">"))


def described_line(kind: str, id: Column | str, description: Column | str) -> Column:
    """``##ALT`` and ``##FILTER`` lines."""
    return F.concat(F.lit(f"##{kind}=<ID="), _col(id), F.lit(',Description="'), _col(description), F.lit('">'))


def fasta(sequence: Column | str, width: int = 60) -> Column:
    """A sequence wrapped in lines of ``width``."""
    return F.regexp_replace(F.regexp_replace(_col(sequence), f"(.{{{width}}})", "$1\n"), "\n$", "")
