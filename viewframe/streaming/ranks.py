"""Ranks in a maintained table (O4, O5, O7, O8): an index of ranges of an order, kept up to date by images.

The order is cut into ranges at bounds taken from a sample; an entry of each row (its order values and id)
lies in its range's bucket, and the version's marker has the count of each range. A rank, a window or a place to
begin at needs those counts and the entries of the ranges that it falls into. Where one range has outgrown the others, the
bounds are taken anew and the entries are written anew, as another generation.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from viewframe.sources.scratch import removed
from viewframe.streaming.store import NEW, Ledger

if TYPE_CHECKING:
    from viewframe.streaming.store import Store

#: Ranges of an order, rows of the sample for each bound, and when one range is too large.
RANGES, SAMPLED, UNEVEN, SLACK = 16, 100, 4, 256


class Ranged(Ledger):
    """A ledger whose buckets are ranges of an order."""

    def bucket(self, *columns: Column) -> Column:
        return F.col("range")


class RankIndex:
    def __init__(self, store: Store, name: str, order: Sequence[tuple[str, str]], ranges: int = RANGES):
        self.store, self.name, self.ranges = store, name, ranges
        self.order = [*order, ("row_id", "asc")]
        self.columns = [c for c, _ in self.order]

    def entries(self, generation: int) -> Ledger:
        schema = T.StructType([T.StructField("range", T.IntegerType()), *(T.StructField(c, self.store.schema[c].dataType) for c in self.columns), T.StructField("n", T.LongType())])
        return Ranged(self.store.spark, f"{self.store.folder}/ranks/{self.name}-{generation}", schema, ["range", *self.columns], ["n"])

    def sorting(self) -> list[Column]:
        """Null is lowest."""
        return [F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_first() for c, way in self.order]

    def literal(self, column: str, text: str | None) -> Column:
        return F.lit(text).cast(self.store.schema[column].dataType)

    def behind(self, values: Sequence[str | None], also_at: bool) -> Column:
        """Whether a row comes after these order values (as texts), or at them."""
        out = F.lit(also_at)
        for (c, way), text in reversed(list(zip(self.order, values, strict=False))):
            value, v = F.col(c), self.literal(c, text)
            if way == "desc":
                after = F.lit(False) if text is None else value.isNull() | (value < v)
            else:
                after = value.isNotNull() if text is None else value.isNotNull() & (value > v)
            out = after | (value.eqNullSafe(v) & out)
        return F.coalesce(out, F.lit(False))

    def ranged(self, rows: DataFrame, bounds: Sequence[Sequence[str | None]]) -> DataFrame:
        number = F.lit(0)
        for b in bounds:
            number = number + self.behind(b, True).cast("int")
        return rows.withColumn("range", number)

    def bounds(self, rows: DataFrame, count: int) -> list[list[str | None]]:
        """Order values that cut the rows into ranges of about the same size, by a sample of a bounded number of rows."""
        want = SAMPLED * self.ranges
        sample = rows.select(*self.columns) if count <= want else rows.select(*self.columns).sample(want / count, 7)
        found = [tuple(r) for r in sample.limit(2 * want).collect()]
        for k in reversed(range(len(self.order))):  # stable, so the first column decides
            down = self.order[k][1] == "desc"
            some, none = [r for r in found if r[k] is not None], [r for r in found if r[k] is None]
            some.sort(key=lambda r: r[k], reverse=down)
            found = some + none if down else none + some
        step = max(1, -(-len(found) // self.ranges))
        return [[None if v is None else repr(v) if isinstance(v, float) else str(v) for v in r] for r in found[step::step]]

    def apply(self, images: DataFrame, version: int, marker: dict) -> dict:
        """Takes in the images of a version, whose changes have been put."""
        told = marker.get(f"rank.{self.name}", {"generation": 0, "bounds": [], "counts": {}, "entries": NEW})
        signed = [images.where(f"{x} is not null").select(*(F.col(f"{x}.{c}").alias(c) for c in self.columns), F.lit(w).cast("long").alias("n")) for x, w in (("o", -1), ("n", 1))]
        entries = self.entries(told["generation"])
        delta = self.ranged(signed[0].unionByName(signed[1]), told["bounds"]).groupBy("range", *self.columns).agg(F.sum("n").alias("n")).where("n <> 0")
        changed = entries.put(delta, version)
        counts = dict(told["counts"])
        for r in entries.deltas(version, version).groupBy("range").agg(F.sum("n").alias("n")).collect():  # a row a range
            counts[str(r["range"])] = counts.get(str(r["range"]), 0) + r["n"]
        total, most = sum(counts.values()), max(counts.values(), default=0)
        if most <= UNEVEN * total / self.ranges + SLACK:
            return {f"rank.{self.name}": told | {"counts": counts, "entries": entries.finish(told["entries"], version, changed)}}
        table, generation = self.store.state(version - 1, more=True), told["generation"] + 1
        bounds, entries = self.bounds(table, total), self.entries(generation)
        whole = self.ranged(table.select(*self.columns), bounds).withColumn("n", F.lit(1).cast("long"))
        changed = entries.put(whole, version)
        counts = {str(r["range"]): r["n"] for r in entries.deltas(version, version).groupBy("range").agg(F.sum("n").alias("n")).collect()}
        return {f"rank.{self.name}": {"generation": generation, "bounds": bounds, "counts": counts, "entries": entries.finish(NEW | {"first": version}, version, changed)}}

    def forget(self, gone: dict, oldest: dict, version: int) -> None:
        """Lets go of entries that no version from the oldest kept one on reads."""
        was, now = gone.get(f"rank.{self.name}"), oldest.get(f"rank.{self.name}")
        if was and now and was["generation"] < now["generation"]:
            removed(self.store.spark, self.entries(was["generation"]).folder)
        elif now:
            self.entries(now["generation"]).cleared(version, now["entries"]["base"])

    # ---- questions at a version ----

    def told(self, version: int) -> dict:
        return self.store.known(version)[f"rank.{self.name}"]

    def held(self, told: dict, version: int, ranges: Sequence[int]) -> DataFrame:
        return self.entries(told["generation"]).state(told["entries"], version, ranges)

    def total(self, version: int) -> int:
        return sum(self.told(version)["counts"].values())

    def window(self, version: int, offset: int, limit: int) -> DataFrame:
        """(row_id, index) of the rows at offset to offset + limit, from the ranges that hold them."""
        told, at, ranges, first = self.told(version), 0, [], None
        for k in range(len(told["bounds"]) + 1):
            n = told["counts"].get(str(k), 0)
            if at < offset + limit and at + n > offset:
                ranges, first = [*ranges, k], at if first is None else first
            at += n
        rows = self.held(told, version, ranges).withColumn("index", F.row_number().over(Window.orderBy(*self.sorting())) + F.lit((first or 0) - 1))
        return rows.where((F.col("index") >= max(0, offset)) & (F.col("index") < offset + limit)).select("row_id", F.col("index").cast("long").alias("index"))

    def place(self, version: int, values: Sequence[Any]) -> int:
        """How many rows come before these order values (a prefix of the order): where a reader who seeks them begins."""
        told = self.told(version)
        texts = [None if v is None else repr(v) if isinstance(v, float) else str(v) for v in values]
        row = self.store.spark.range(1).select(*(self.literal(c, t).alias(c) for (c, _), t in zip(self.order, texts, strict=False)))
        prefix = [b[: len(texts)] for b in told["bounds"]]
        number = F.lit(0)
        for b in prefix:  # ranges that end before the values
            number = number + self.behind(b, False).cast("int") if len(texts) < len(self.order) else number + self.behind(b, True).cast("int")
        inside = row.select(number.alias("k")).first()["k"]
        below = sum(told["counts"].get(str(k), 0) for k in range(inside))
        return below + self.held(told, version, [inside]).where(~self.behind(texts, True)).count()

    def rank(self, version: int, row_id: Any) -> int | None:
        """The index of a row, null if it is not there: its own bucket tells its values, its range the rest."""
        id = self.store.spark.range(1).select(F.lit(row_id).cast(self.store.schema["row_id"].dataType).alias("row_id"))
        bucket = [id.select(self.store.rows.bucket(F.col("row_id"))).first()[0]]
        row = self.store.state(version, buckets=bucket).join(id, "row_id", "left_semi").select(*self.columns).first()
        return None if row is None else self.place(version, tuple(row))

    def around(self, version: int, row_id: Any, before: int, after: int) -> DataFrame:
        """A window anchored at a row: so many before it, itself, so many after it; empty if it is not there."""
        at = self.rank(version, row_id)
        if at is None:
            return self.window(version, 0, 0)
        return self.window(version, max(0, at - before), at + after + 1 - max(0, at - before))
