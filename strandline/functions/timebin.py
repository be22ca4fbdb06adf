"""Durations and epoch-aligned time buckets."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {
    1e-9: "ns nanosecond nanoseconds", 1e-6: "us microsecond microseconds", 1e-3: "ms millisecond milliseconds", 1: "s sec secs second seconds", 60: "m min mins minute minutes",
    3600: "h hr hrs hour hours", 86400: "d day days", 604800: "w week weeks",
}
_LENGTH = {name: length for length, names in _UNITS.items() for name in names.split()}
_PART = r"(\d+(?:\.\d+)?)\s*([a-zA-Z]+)\s*"


def seconds(duration: str) -> int:
    """Whole seconds of a duration such as 1h, 90s, 15min or `4 hours`; parts below a second are cut off."""
    if not re.fullmatch(rf"\s*(?:{_PART})+", duration):
        raise ValueError(f"not a duration: {duration!r}")
    total = 0.0
    for number, unit in re.findall(_PART, duration):
        if unit.lower() not in _LENGTH:
            raise ValueError(f"unknown unit in {duration!r}")
        total += float(number) * _LENGTH[unit.lower()]
    return int(total + 1e-9)


def bucket(ts: Column, duration: str) -> Column:
    """Start of the epoch-aligned bucket that ts lies in."""
    return F.window(ts, f"{seconds(duration)} seconds")["start"]


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp with or without a zone (UTC)."""
    return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def from_epoch_seconds(seconds_: Column) -> Column:
    return F.timestamp_add("SECOND", seconds_, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


def at(epoch: int) -> Column:
    """The literal time of an epoch second, which scans can compare with."""
    return F.expr(f"timestamp_ntz'{dt.datetime.fromtimestamp(epoch, dt.UTC):%Y-%m-%d %H:%M:%S}'")
