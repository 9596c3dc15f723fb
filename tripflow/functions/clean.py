"""Column cleaning: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value.
SENTINELS = ["", "null", "nan", "none", "nat"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_string(c: Column | str) -> Column:
    text = F.trim(_col(c).cast("string"))
    return F.when(~F.lower(text).isin(SENTINELS), text)


def clean_double(c: Column | str) -> Column:
    return clean_string(c).try_cast("double")


def clean_int(c: Column | str) -> Column:
    """Tolerant integer: "3", "3.0" and 3.7 (as 3); anything else is null."""
    return clean_double(c).try_cast("int")


def clean_timestamp(c: Column | str) -> Column:
    """ISO-8601 with or without a zone; null if it isn't one."""
    return F.try_to_timestamp(clean_string(c))


def slot_ts(c: Column | str) -> Column:
    """Slot keys as instants in the session's zone (UTC), in microseconds."""
    return _col(c).cast("timestamp")


def flag(c: Column | str, yes: str = "Y") -> Column:
    return F.when(_col(c) == yes, 1).otherwise(0)


def is_provider(c: Column | str, license_num: str = "HV0003") -> Column:
    return flag(c, license_num)


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("SECOND", _col(start), _col(end))


def metric_name(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "[^A-Za-z0-9_:-]", "_")


def progress_epoch(c: Column | str) -> Column:
    """Epoch seconds of an ISO progress timestamp; 0 if it isn't one."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(_col(c))), F.lit(0))
