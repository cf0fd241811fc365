"""Orders, windows of a result, ranks, and moving through them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from viewframe.functions.exact import sort_token
from viewframe.functions.text import utf16_order
from viewframe.sources.scratch import written
from viewframe.sources.schema import Schema

COMPAT = "compat"
MAX_KEYS, MAX_WINDOW = 8, 4096
Order = tuple[str, str]  # path, "asc" or "desc"


def key_parts(schema: Schema, path: str, profile: str = "native") -> list[Column]:
    """What a field sorts by: its state, then its value. Native: missing, null, value; compat: null, missing, value."""
    f = schema[path]
    state = f.state
    if profile == COMPAT:
        state = F.when(f.column.isNotNull(), 2).when(f.present & f.column.isNull(), 0).otherwise(1)
    value = f.column
    if f.kind == "string" and profile == COMPAT:
        value = utf16_order(value)
    elif f.kind == "wide_decimal":
        value = sort_token(value)
    return [state, value]


def sort_columns(schema: Schema, order_by: Sequence[Order], key: str, profile: str = "native") -> list[Column]:
    """desc turns everything round, states too; equal rows go by key, always upwards."""
    if len(order_by) > MAX_KEYS:
        raise ValueError("at most 8 sort keys")
    out = []
    for path, way in order_by:
        out += [c.desc() if way == "desc" else c.asc() for c in key_parts(schema, path, profile)]
    return [*out, F.col(key).asc()]


#: A window that ends beyond so many rows is found by counting ranges; up to there a top-n holds it in each task.
TOP_ROWS = 100_000


def window(df: DataFrame, columns: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit - 1 of the order. A deep window runs a job that ranges the rows."""
    if offset + limit <= TOP_ROWS:
        return df.orderBy(*columns).offset(offset).limit(limit)
    ranks = ranked(df, columns)
    return ranks.where((F.col("__rank") >= offset) & (F.col("__rank") < offset + limit)).orderBy("__rank").drop("__rank")


def ranked(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """df with __rank, from 0. Rows are dealt by ranges of the order and written; a range's rows are counted
    (a number per range) and numbered in it, so no task or driver holds more than a range."""
    parts = written(df.repartitionByRange(*columns).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*columns))
    return parts.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn("__rank", F.col("__before") + F.col("__own") - 1).drop("__part", "__own", "__n", "__before")


def with_total(page: DataFrame, whole: DataFrame) -> DataFrame:
    """page with total_rows, the count before pagination. An empty page has no row to carry it; use total_rows()."""
    return page.withColumn("total_rows", whole.agg(F.count(F.lit(1))).scalar())


def rank_of(df: DataFrame, schema: Schema, order_by: Sequence[Order], key: str, id: object, profile: str = "native") -> int | None:
    """Rows before a row in the order; None if it is not there. Counted, nothing is sorted."""
    parts = [(c.alias(f"k{i}_{j}"), way) for i, (path, way) in enumerate(order_by) for j, c in enumerate(key_parts(schema, path, profile))]
    names = [f"k{i}_{j}" for i in range(len(order_by)) for j in range(2)]
    ways = [way for _, way in parts]
    keyed = df.select(*(c for c, _ in parts), F.col(key).alias("k"))
    row = keyed.where(F.col("k") == id).limit(1).collect()  # one row
    if not row:
        return None
    before, equal = F.lit(False), F.lit(True)
    for name, way in zip(names, ways, strict=True):
        here, there = F.col(name), F.lit(row[0][name])
        less = (here > there) if way == "desc" else (here < there)
        before = before | (equal & F.coalesce(less, F.lit(False)))
        equal = equal & here.eqNullSafe(there)
    return keyed.where(before | (equal & (F.col("k") < row[0]["k"]))).count()


def at_rank(df: DataFrame, columns: Sequence[Column], rank: int) -> DataFrame:
    return window(df, columns, rank, 1)


def start_of(mode: str, total: int, limit: int, rank: int = 0) -> int:
    """First rank of a window that follows the start or the end, or scrolls to a rank (clamped), or seeks it (checked)."""
    last = max(total - limit, 0)
    if mode == "start":
        return 0
    if mode == "end":
        return last
    if mode == "scroll":
        return min(max(rank, 0), last)
    if mode == "seek":
        if not 0 <= rank < max(total, 1):
            raise ValueError("no such rank")
        return rank
    return rank  # "fixed"


def anchored_start(new_rank: int | None, old_rank: int, slot: int, total: int, limit: int) -> int:
    """First rank that keeps an anchor row at its slot; near the top the slot shrinks. A row that is gone leaves its old rank."""
    rank = min(old_rank, max(total - 1, 0)) if new_rank is None else new_rank
    return min(max(rank - slot, 0), max(total - limit, 0))


def numbered(df: DataFrame, columns: Sequence[Column], offset: int, limit: int, name: str = "index") -> DataFrame:
    """A bounded window with each row's rank; only its rows are numbered, so one task holds at most MAX_WINDOW."""
    if limit > MAX_WINDOW:
        raise ValueError("a numbered window has at most 4096 rows")
    page = window(df, columns, offset, limit)
    return page.withColumn(name, F.row_number().over(Window.orderBy(*columns)) - 1 + offset)
