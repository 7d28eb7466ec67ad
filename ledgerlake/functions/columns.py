"""Column expressions shared by the operators; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY, WEEK, MONTH, CATEGORY = "daily", "weekly", "monthly", "category"
CATEGORY_BYTES = 128


def iso_week(ts: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def partition_key(ts: Column, strategy: str) -> Column:
    """Key of the calendar day, ISO week or month that ts lies in."""
    if strategy == DAY:
        return F.date_format(ts, "yyyy-MM-dd")
    if strategy == WEEK:
        return iso_week(ts)
    if strategy == MONTH:
        return F.date_format(ts, "yyyy-MM")
    raise ValueError(f"no calendar key for {strategy!r}")


def fired_partition_key(ts: Column, strategy: str) -> Column:
    """Key of the period before the one that ts lies in (months are calendar months)."""
    before = {DAY: F.date_sub(ts.cast("date"), 1), WEEK: F.date_sub(ts.cast("date"), 7), MONTH: F.add_months(ts.cast("date"), -1)}
    return partition_key(before[strategy], strategy)


def valid_category_key(key: Column) -> Column:
    return (F.octet_length(key) > 0) & (F.octet_length(key) <= CATEGORY_BYTES) & ~key.contains("/")


def valid_partition_key(key: Column, strategy: str) -> Column:
    """Whether a run key has the strategy's shape and names a date that exists."""
    if strategy == CATEGORY:
        return F.coalesce(valid_category_key(key), F.lit(False))
    if strategy == DAY:
        ok = key.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(key, F.lit("yyyy-MM-dd")).isNotNull()
    elif strategy == MONTH:
        ok = key.rlike(r"^\d{4}-(0[1-9]|1[0-2])$")
    else:
        # week 53 exists where the year's last Thursday lies in it
        year, week = F.substr(key, F.lit(1), F.lit(4)).try_cast("int"), F.substr(key, F.lit(7), F.lit(2)).try_cast("int")
        ok = key.rlike(r"^\d{4}-W(0[1-9]|[1-4]\d|5[0-3])$") & ((week < 53) | (F.weekofyear(F.make_date(year, F.lit(12), F.lit(28))) == 53))
    return F.coalesce(ok, F.lit(False))


def ordered_union(*roles: Column) -> Column:
    """Values of all arrays, each once, in the order they first occur; nulls count as empty arrays."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*(F.coalesce(r, empty) for r in roles)))


def canonical_json(flat: Column) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(flat))))


def big_endian(n: Column) -> Column:
    """The 8 bytes of a long, most significant first."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))
