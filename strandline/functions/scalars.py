"""Scalar functions over string-typed properties, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_uint(c: Column | str) -> Column:
    """An unsigned integer; empty or bad text is 0."""
    text = F.trim(col(c))
    return F.coalesce(F.when(text.rlike("^[0-9]+$"), text.try_cast("long")), F.lit(0).cast("long"))


def to_double(c: Column | str) -> Column:
    return F.coalesce(F.trim(col(c)).try_cast("double"), F.lit(0.0))


def is_blocked(c: Column | str) -> Column:
    return F.coalesce(col(c).isin("true", "TRUE", "True", "1"), F.lit(False))


def time_millis(c: Column | str) -> Column:
    """Digits pass through; ``YYYY-MM-DD``, with an optional time behind a space or T, is UTC, its offset dropped; else, and before 1970, 0."""
    text = F.trim(col(c))
    day = F.regexp_extract(text, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    clock = F.regexp_extract(text, r"^[0-9-]{10}[ T]([0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,3})?)", 1)
    stamp = F.concat_ws(" ", day, F.when(clock != "", clock)).try_cast("timestamp")
    return F.when(text.rlike("^[0-9]{1,18}$"), text.cast("long")).otherwise(F.greatest(F.coalesce(F.unix_millis(stamp), F.lit(0).cast("long")), F.lit(0).cast("long")))


def event_month(ms: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(col(ms)), "yyyyMM")


def event_weekday(ms: Column | str) -> Column:
    """0 is Sunday."""
    return (F.dayofweek(F.timestamp_millis(col(ms))) - 1).cast("int")


def length_bucket(n: Column | str) -> Column:
    n = col(n)
    return F.when(n < 40, 0).when(n < 80, 1).when(n < 160, 2).otherwise(3)


def edge_type_code(t: Column | str) -> Column:
    return F.lpad(col(t).cast("string"), 2, "0")


def edge_weight(a: Column | str, b: Column | str) -> Column:
    return 1 + col(a).bitwiseXOR(col(b)) % 100


def latency_minutes(later: Column | str, earlier: Column | str) -> Column:
    """Whole minutes, cut towards zero."""
    d = col(later) - col(earlier)
    return F.signum(d).cast("long") * F.floor(F.abs(d) / 60000)


def split_list(c: Column | str) -> Column:
    """A ``;``-separated list, trimmed, without empty entries and -1."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: (x != "") & (x != "-1"))


def split_pairs(c: Column | str) -> Column:
    """``a,b;c,d`` as an array of structs."""
    return F.transform(split_list(c), lambda x: F.struct(F.trim(F.split(x, ",")[0]).alias("id"), F.coalesce(F.trim(F.get(F.split(x, ","), F.lit(1))), F.lit("")).alias("val")))


def pipe_get(c: Column | str, slot: int) -> Column:
    return F.coalesce(F.get(F.split(col(c), r"\|", -1), F.lit(slot)), F.lit(""))


def pipe_set(c: Column | str, slot: int, value: Column | str) -> Column:
    """The fields with one replaced; missing ones before it are empty."""
    fields = F.split(col(c), r"\|", -1)
    wide = F.concat(fields, F.array_repeat(F.lit(""), F.greatest(F.lit(slot + 1) - F.size(fields), F.lit(0))))
    return F.array_join(F.transform(wide, lambda x, i: F.when(i == slot, col(value)).otherwise(x)), "|")


def fixed_width(c: Column | str, width: int) -> Column:
    """Cut to ``width`` bytes of UTF-8; closing NULs are dropped."""
    cut = F.substring(F.encode(col(c), "utf-8"), 1, width).cast("string")
    return F.regexp_replace(cut, "\u0000+$", "")


def ratio(a: Column | str, b: Column | str) -> Column:
    return F.when(col(b) == 0, 0.0).otherwise(col(a) / col(b))


def message_content(image: Column | str, content: Column | str) -> Column:
    return F.when(F.coalesce(col(image), F.lit("")) != "", col(image)).otherwise(F.coalesce(col(content), F.lit("")))
