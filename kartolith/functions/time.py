"""Sequence numbers (minutes of the feed) and day keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = 1_347_432_900
MINUTE = 60


def sequence_of(ts: Column) -> Column:
    return F.floor((F.unix_timestamp(ts.cast("timestamp")) - EPOCH) / MINUTE).cast("long")


def time_of(sequence: Column) -> Column:
    return F.timestamp_seconds(sequence.cast("long") * MINUTE + EPOCH)


def day_key(ts: Column) -> Column:
    return (F.year(ts) * 1000 + F.dayofyear(ts)).cast("int")
