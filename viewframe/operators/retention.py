"""Retention by age and by count."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from viewframe.operators.order import ranked, window

FUTURE_MS, CHUNK = 300_000, 256


def minutes_to_ms(minutes: float) -> int:
    """Rounded up, so that no row leaves early."""
    if not math.isfinite(minutes) or minutes <= 0:
        raise ValueError("an age is a positive number of minutes")
    return math.ceil(minutes * 60_000)


@dataclass(frozen=True)
class Policy:
    """At least one maximum; counts of the whole topic and per key exclude each other and need their cleanup."""

    max_age_ms: int | None = None
    max_rows: int | None = None
    max_rows_per_key: int | None = None
    cleanup: str = "delete"

    def __post_init__(self) -> None:
        if not any((self.max_age_ms, self.max_rows, self.max_rows_per_key)):
            raise ValueError("a policy has a maximum")
        if self.max_rows and self.max_rows_per_key:
            raise ValueError("count the whole topic or each key")
        if (self.max_rows and self.cleanup != "delete") or (self.max_rows_per_key and self.cleanup != "compact"):
            raise ValueError("a topic's count needs delete, a key's count compact")


def expired(ts_ms: Column, max_age_ms: int, reference_ms: int) -> Column:
    """The boundary is included."""
    return ts_ms + F.lit(max_age_ms) <= F.lit(reference_ms)


def by_age(df: DataFrame, ts_ms: Column, max_age_ms: int, reference_ms: int) -> DataFrame:
    return df.where(~expired(ts_ms, max_age_ms, reference_ms))


def newest(df: DataFrame, order: str, n: int, id: str) -> DataFrame:
    """The newest n rows by admission order, of equal ones those with the smaller ids. Only order and id are
    sorted to find the last row that stays; then rows are filtered, so the payload is not brought together."""
    columns = [F.desc(order), F.asc(id)]
    last = window(df.select(order, id), columns, max(n - 1, 0), 1).select(F.struct(F.col(order).alias("order"), F.col(id).alias("id")).alias("x"))
    bound = last.scalar()
    older = (F.col(order) < bound["order"]) | ((F.col(order) == bound["order"]) & (F.col(id) > bound["id"]))
    return df.where(F.coalesce(~older, F.lit(True)) if n else F.lit(False))


def newest_per_key(df: DataFrame, key: str, order: str, n: int, id: str) -> DataFrame:
    """Spark limits each key's rows before the shuffle (a window group limit), so a hot key is cut map-side."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.asc(id))))
    return ranked.where(F.col("__n") <= n).drop("__n")


def retained(df: DataFrame, policy: Policy, ts_ms: Column, order: str, key: str, reference_ms: int, id: str) -> DataFrame:
    """Age first, then count; rows of equal order stay by id."""
    if policy.max_age_ms:
        df = by_age(df, ts_ms, policy.max_age_ms, reference_ms)
    if policy.max_rows:
        df = newest(df, order, policy.max_rows, id)
    if policy.max_rows_per_key:
        df = newest_per_key(df, key, order, policy.max_rows_per_key, id)
    return df


def admission_state(ts_ms: Column, max_age_ms: int, reference_ms: int) -> Column:
    """error: no time or one too far ahead; expired: admitted and at once absent; live."""
    late = ts_ms.isNull() | (ts_ms > F.lit(reference_ms + FUTURE_MS))
    return F.when(late, "error").when(expired(ts_ms, max_age_ms, reference_ms), "expired").otherwise("live")


def reference_time(wall_ms: int, last_ms: int | None) -> int:
    """It never goes back."""
    return max(wall_ms, last_ms or 0)


def expiry_changes(df: DataFrame, id: str, ts_ms: Column, max_age_ms: int, reference_ms: int) -> DataFrame:
    """Deletes of what is due, oldest first in chunks of CHUNK rows: (id, op, chunk). They go through views like any others."""
    due = df.where(expired(ts_ms, max_age_ms, reference_ms)).select(F.col(id), ts_ms.alias("__ts"))
    return ranked(due, [F.col("__ts").asc(), F.col(id).asc()]).select(id, F.lit("delete").alias("op"), F.floor(F.col("__rank") / CHUNK).cast("long").alias("chunk"))


def due(df: DataFrame, id: str, ts_ms: Column, max_age_ms: int, reference_ms: int) -> DataFrame:
    """Deletes of what is due, where their order does not matter."""
    return df.where(expired(ts_ms, max_age_ms, reference_ms)).select(F.col(id), F.lit("delete").alias("op"))
