"""Times shared by the tests (a plain module: `conftest` names more than one file)."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

T0 = datetime(2026, 9, 7, 12, 0, 0, tzinfo=timezone.utc)


def stamp(seconds=0):
    return T0 + timedelta(seconds=seconds)


def lit_ts(when):
    return F.lit(when)
