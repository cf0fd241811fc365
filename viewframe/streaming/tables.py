"""Maintained tables and views on Structured Streaming.

A micro-batch is a version. A version writes only what it changes (store.py): the last image per touched row, and the
images before and after, from which deltas, groups and joined views follow. A version is marked as done last, in one small
file that also holds what the next one needs to know; readers never see part of a version, and a batch
that is given again writes the same again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewframe.operators import changes as C
from viewframe.operators import edits, joins
from viewframe.operators import retention as R
from viewframe.sources.scratch import removed
from viewframe.streaming import keyed, store
from viewframe.streaming.groups import GroupView, Measure
from viewframe.streaming.ranks import RankIndex
from viewframe.streaming.store import BUCKETS, Ledger, Store

__all__ = ["MaintainedJoin", "MaintainedTable", "Measure", "change_stream", "regrouped"]

#: After so many deltas of a window its subscribers get it whole again.
DELTAS = 8


def regrouped(groups: DataFrame, table: DataFrame, touched: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Column]) -> DataFrame:
    """Groups after changes (A24): only touched ones are computed again, others stay as they are.

    table: after the changes. touched: keys of the old and new images of changed rows.
    """
    names = [f"__t{i}" for i in range(len(keys))]
    hit = touched.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True))).distinct()
    same = lambda df: [df[k].eqNullSafe(hit[n]) for k, n in zip(keys, names, strict=True)]
    again = table.join(hit, same(table), "left_semi").groupBy(*keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    return groups.join(hit, same(groups), "left_anti").unionByName(again)


class Derived:
    """Grouped views over a store's rows and windows that are subscribed to, kept up to date by its images."""

    def __init__(self, store_: Store, views: Mapping[str, tuple[Sequence[str], Mapping[str, Measure]]], windows: Mapping[str, Callable[[DataFrame], DataFrame]], ranks: Mapping[str, Sequence[tuple[str, str]]] | None = None):
        self.store, self.windows = store_, windows
        self.ranks = {name: RankIndex(store_, name, order) for name, order in (ranks or {}).items()}
        self.views = {name: GroupView(store_.spark, f"{store_.folder}/views/{name}", store_.schema, *view, store_.rows.buckets) for name, view in views.items()}

    @property
    def ledgers(self) -> dict[str, Ledger]:
        return {f"{name}.{part}": ledger for name, view in self.views.items() for part, ledger in view.ledgers.items()}

    def known(self, view: str, marker: dict) -> dict[str, dict]:
        return {part: marker[f"{view}.{part}"] for part in self.views[view].ledgers if f"{view}.{part}" in marker}

    def apply(self, images: DataFrame, version: int, marker: dict) -> dict:
        """What the next marker says of the views and windows. The version's changes have been put."""
        more: dict = {"windows": marker.get("windows", {})}
        for name, view in self.views.items():
            more |= {f"{name}.{part}": known for part, known in view.apply(images, version, self.known(name, marker)).items()}
        for index in self.ranks.values():
            more |= index.apply(images, version, marker)
        for name, make in self.windows.items():
            more["windows"] = more["windows"] | {name: self.sent(name, make(self.store.state(version - 1, more=True)), more["windows"].get(name), version)}
        return more

    def read(self, view: str, version: int) -> DataFrame:
        return self.views[view].read(self.known(view, self.store.known(version)), version)

    # ---- windows (D3-D7) ----

    def sent(self, name: str, window: DataFrame, last: dict | None, version: int) -> dict:
        """Writes what a subscriber of a window gets with a version: nothing if it looks the same, a script, or the whole window."""
        path = lambda what, v: self.store.path(f"{name}-{what}", v)
        window.write.mode("overwrite").parquet(path("whole", version))
        window = self.store.spark.read.parquet(path("whole", version))
        columns = [c for c in window.columns if c not in ("row_id", "index")]
        content = 0 if last is None else last["content"] + 1
        if last is not None:
            before = self.store.spark.read.parquet(path("whole", last["version"]))
            C.window_diff(before, window, columns).write.mode("overwrite").parquet(path("delta", version))
            script = self.store.spark.read.parquet(path("delta", version))
            told = C.window_operations(script, window).first()
            if not told["operations"]:
                return last | {"seen": version}
            if not told["snapshot"] and len(last["chain"]) <= DELTAS:
                fresh = script.where("change in ('insert', 'update')").select("row_id").distinct()
                window.join(fresh, "row_id", "left_semi").drop("index").write.mode("overwrite").parquet(path("rows", version))
                return {"content": content, "version": version, "base": last["version"], "kind": "delta", "seen": version, "chain": [*last["chain"], version]}
        return {"content": content, "version": version, "base": None, "kind": "snapshot", "seen": version, "chain": [version]}

    def received(self, name: str, version: int) -> DataFrame:
        """A subscriber's window at a version, put together from what was sent since the last whole window."""
        first, *rest = self.store.known(version)["windows"][name]["chain"]
        out, read = self.store.spark.read.parquet(self.store.path(f"{name}-whole", first)), self.store.spark.read.parquet
        for before, v in zip([first, *rest], rest, strict=False):
            out = C.reconstructed(out, read(self.store.path(f"{name}-delta", v)), read(self.store.path(f"{name}-rows", v)), before, before)
        return out

    def forget(self, gone: int, oldest: dict) -> None:
        """Windows' folders that no version from gone + 1 on is put together from."""
        paths = []
        for name, told in oldest.get("windows", {}).items():
            was = self.store.known(gone).get("windows", {}).get(name)
            free = ({gone} | set(was["chain"] if was else ())) - set(told["chain"])
            paths += [self.store.path(f"{name}-{what}", v) for v in free for what in ("whole", "delta", "rows")]
        removed(self.store.spark, *paths)
        for index in self.ranks.values():
            index.forget(self.store.known(gone), oldest, gone)

    def finish(self, version: int, more: dict, others: Mapping[str, Ledger] | None = None, folders: Sequence[str] = ()) -> None:
        """Marks the version as done, and lets go of what is too old for readers."""
        gone = version - store.KEPT
        if gone >= 0 and self.store.there(gone):
            self.forget(gone, self.store.known(gone + 1))
        self.store.finish(version, more, list((self.ledgers | dict(others or {})).items()), folders)


@dataclass
class MaintainedTable:
    """A table folded from a stream of changes, with grouped views over it and windows that are subscribed to."""

    spark: SparkSession
    folder: str
    schema: T.StructType  # of the table: row_id and payload
    order: Sequence[str] = ("offset",)
    views: Mapping[str, tuple[Sequence[str], Mapping[str, Measure]]] = field(default_factory=dict)
    on_delta: Callable[[DataFrame, int], None] | None = None
    policy: R.Policy | None = None  # rows that it drops leave with the batch that makes them due
    time_column: str = "ts_ms"
    key_column: str = "row_id"  # of a policy that counts per key
    source: tuple[str, str] | None = None  # partition and offset columns; if given, batches are audited before they are applied
    windows: Mapping[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)  # of the table: numbered windows of at most 4096 rows
    buckets: int = BUCKETS
    ranks: Mapping[str, Sequence[tuple[str, str]]] = field(default_factory=dict)  # orders that rows are numbered by, as (column, asc or desc)
    keyed: bool = False  # run() knows the rows by keyed state instead of reading the table's buckets; age is all that a policy can ask then

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.folder, self.schema, self.buckets)
        self.derived = Derived(self.store, self.views, self.windows, self.ranks)
        if self.keyed and (self.source or self.policy and (self.policy.max_rows or self.policy.max_rows_per_key)):
            raise ValueError("keyed state knows ages only, and no offsets")
        self.retention = Retention(self) if self.policy and not self.keyed else None

    def version(self) -> int:
        return self.store.version()

    def read(self, what: str, version: int) -> DataFrame:
        """The table or a grouped view at a version."""
        return self.store.state(version) if what == "table" else self.derived.read(what, version)

    def received(self, name: str, version: int) -> DataFrame:
        return self.derived.received(name, version)

    def delta(self, version: int) -> DataFrame:
        """(row_id, columns, weight): what a version took and gave."""
        images = self.store.images(version, version)
        sides = [images.where(f"{x} is not null").select("row_id", *(f"{x}.{c}" for c in self.store.columns), F.lit(w).alias("weight")) for x, w in (("o", -1), ("n", 1))]
        return sides[0].unionByName(sides[1])

    def apply(self, batch: DataFrame, version: int, begin: dict | None = None) -> None:
        """One batch. begin: what the marker says besides, of a batch that is not the source's. Given again it reads the same previous version and overwrites its own folders."""
        marker = self.store.known(version - 1)
        more: dict = dict(begin or {})
        if begin is None and "positions" in marker:
            batch, more["positions"] = self.tail(batch, marker["positions"])
        elif begin is None and self.source:
            batch = self.audited(batch, version)
        changes = C.latest(batch.select("row_id", "op", *dict.fromkeys([*self.order, *self.store.columns])), order=self.order)
        changes = changes.select(*self.store.change_schema.names)
        if self.retention:
            changes, more["reference"] = self.retention.dropped(changes, marker, version)
        images = self.store.imaged(self.store.put(changes, version), version)
        self.taken_in(images, version, marker, more)

    def apply_images(self, images: DataFrame, version: int) -> None:
        """One batch of keyed state: row_id, o and n of the rows that it changes."""
        path = self.store.path("images", version)
        images.select("row_id", "o", "n").write.mode("overwrite").parquet(path)
        images = self.store.images(version, version)
        columns = [F.col(f"n.{c}").alias(c) for c in self.store.columns]
        self.store.put(images.select("row_id", *columns, F.when(F.col("n").isNull(), C.DELETE).otherwise(C.UPSERT).alias("op")), version)
        self.taken_in(images, version, self.store.known(version - 1), {})

    def taken_in(self, images: DataFrame, version: int, marker: dict, more: dict) -> None:
        """What follows from a version's images; then the version is done."""
        if self.retention:
            more |= self.retention.apply(images, marker, version)
        more |= self.derived.apply(images, version, marker)
        if self.on_delta:
            self.on_delta(self.delta(version), version)
        self.derived.finish(version, more, self.retention.ledgers if self.retention else None, ("offsets", "kept-images"))

    # ---- handoff (S12) and edits (E1) ----

    def seed(self, snapshot: DataFrame, positions: Mapping[str, int]) -> None:
        """Begins with a snapshot (the table's columns) that holds what the source's partitions had up to and with these offsets.

        From then on the tail must go on where the snapshot ends: what it brings again is dropped, a gap fails the batch.
        """
        if self.version() >= 0 or not self.source:
            raise ValueError("a snapshot begins a table whose source is known")
        twice = C.repeated_ids(snapshot).first()
        if twice:
            raise ValueError(f"the snapshot holds {twice['row_id']} more than once")
        self.apply(snapshot.withColumn("op", F.lit(C.UPSERT)), 0, {"positions": {str(k): int(v) for k, v in positions.items()}})

    def tail(self, batch: DataFrame, positions: dict[str, int]) -> tuple[DataFrame, dict[str, int]]:
        """A batch without what is at or below the positions, and the positions after it. It must be gapless in every partition."""
        partition, offset = self.source
        known = F.create_map(*(F.lit(x) for kv in positions.items() for x in kv)) if positions else F.expr("cast(map() as map<string,int>)")
        at = F.coalesce(F.try_element_at(known, F.col(partition).cast("string")), F.lit(-1))
        fresh = batch.where(F.col(offset) > at)
        seen = fresh.groupBy(F.col(partition).cast("string").alias("p")).agg(F.min(offset).alias("first"), F.max(offset).alias("last"), F.count_distinct(offset).alias("n")).collect()  # a row per partition of the source
        for r in seen:
            if r["first"] != positions.get(r["p"], -1) + 1 or r["last"] - r["first"] + 1 != r["n"]:
                raise ValueError(f"offsets are missing in partition {r['p']} after {positions.get(r['p'], -1)}")
        return fresh, positions | {r["p"]: r["last"] for r in seen}

    def edit(self, changes: DataFrame, columns: Sequence[str], owner: str, identity: Sequence[str] = ()) -> int:
        """A batch of edits as the next version, whole or not at all; the version that it became.

        changes: op, the table's columns, and expected, a struct of columns as the editor saw them. Of two writers that start
        from the same version one is refused before anything is written, and so is who expects what is not there.
        """
        version = self.version() + 1
        self.store.claim(version, owner)
        try:
            ids = changes.select("row_id")
            buckets = [r[0] for r in ids.select(self.store.rows.bucket(F.col("row_id"))).distinct().collect()]  # at most one row a bucket
            before = self.store.state(version - 1, buckets=buckets).join(ids.distinct(), "row_id", "left_semi")
            if bad := edits.conflicts(before, changes, columns, "row_id", identity=list(identity)).first():
                raise ValueError(f"{bad['reason']} at row {bad['row_id']}")
            positions = self.store.known(version - 1).get("positions")
            self.apply(changes.drop("expected"), version, {"positions": positions} if positions else {})
        except Exception:
            self.store.release(version)
            raise
        return version

    # ---- audits (S10) ----

    def audited(self, batch: DataFrame, version: int) -> DataFrame:
        """The batch without records that were applied before; a record that differs from what stood at its place, or is too late to tell, fails it."""
        partition, offset = self.source
        digest = F.sha2(F.to_json(F.struct("row_id", "op", *(c for c in self.store.columns if c != offset))), 256)
        kinds = f"{partition} {batch.schema[partition].dataType.simpleString()}, {offset} long, __digest string"
        seen = self.spark.read.schema(kinds).parquet(self.store.path("offsets", version - 1)) if version else self.spark.createDataFrame([], kinds)
        rows = batch.withColumn("__digest", digest)
        own = rows.groupBy(partition, offset).agg(F.min("__digest").alias("__digest"), (F.min("__digest") != F.max("__digest")).alias("__torn"))
        newest = seen.groupBy(F.col(partition).alias("__p")).agg(F.max(offset).alias("__newest"))  # a row per partition
        before = seen.select(F.col(partition).alias("__p"), F.col(offset).alias("__o"), F.col("__digest").alias("__was"))
        told = own.join(F.broadcast(newest), F.col(partition) == F.col("__p"), "left").drop("__p").join(before, (F.col(partition) == F.col("__p")) & (F.col(offset) == F.col("__o")), "left").drop("__p", "__o")
        verdict = (
            F.when(F.col("__torn"), "conflict").when(F.col("__newest").isNull() | (F.col(offset) > F.col("__newest")), "new")
            .when(F.col("__newest") - F.col(offset) > C.HORIZON, "stale").when(F.col("__was") == F.col("__digest"), "replay").otherwise("conflict")
        )
        told = told.withColumn("audit", verdict)
        bad = told.where("audit in ('conflict', 'stale')").first()
        if bad:
            raise ValueError(f"{bad['audit']} at offset {bad[offset]} of partition {bad[partition]}")
        fresh = told.where("audit = 'new'").select(partition, offset, "__digest")
        R.newest_per_key(seen.unionByName(fresh), partition, offset, C.HORIZON + 1, "__digest").write.mode("overwrite").parquet(self.store.path("offsets", version))
        places = fresh.select(F.col(partition).alias("__p"), F.col(offset).alias("__o"))
        return rows.join(places, (F.col(partition) == F.col("__p")) & (F.col(offset) == F.col("__o")), "left_semi").drop("__digest")

    def run(self, stream: DataFrame, checkpoint: str):
        """Streams all changes that are there, a version a micro-batch."""
        if self.keyed:
            return keyed.run(self, stream, checkpoint)
        query = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query


#: A queue's slot is so large a part of the greatest age.
SLOTS_OF_AGE = 64


class Slots(Ledger):
    """A ledger whose buckets are slots of time."""

    width: int

    def bucket(self, *columns: Column) -> Column:
        return F.floor(F.col("ts") / self.width).cast("int")


class Retention:
    """What a policy drops with each batch (R2-R8), without a look at rows that the batch and the clock leave alone.

    Age: a queue of rows in slots of their time; of it, the slots that have become due since the version before are read. Count per key: a ledger of
    the rows of each key, of which the batch's keys are read. The count of a whole topic is a top-n of the table.
    """

    def __init__(self, table: MaintainedTable):
        self.table, self.store, self.policy = table, table.store, table.policy
        id, long = table.schema["row_id"], T.LongType()
        self.ledgers: dict[str, Ledger] = {}
        if self.policy.max_age_ms:
            schema = T.StructType([id, T.StructField("ts", long), T.StructField("n", long)])
            self.queue = self.ledgers["queue"] = Slots(table.spark, f"{table.folder}/queue", schema, ["row_id", "ts"], ["n"])
            self.queue.width = max(1, self.policy.max_age_ms // SLOTS_OF_AGE)
        if self.policy.max_rows_per_key:
            order = table.schema[table.order[0]].dataType
            schema = T.StructType([T.StructField("key", table.schema[table.key_column].dataType), id, T.StructField("place", order), T.StructField("n", long)])
            self.held = self.ledgers["held"] = Ledger(table.spark, f"{table.folder}/held", schema, ["key", "row_id", "place"], ["n"], ["key"], table.buckets)

    def signed(self, images: DataFrame, **columns: str) -> DataFrame:
        """row_id, columns and n: -1 for what was, 1 for what is."""
        sides = [images.where(f"{x} is not null").select("row_id", *(F.col(f"{x}.{c}").alias(n) for n, c in columns.items()), F.lit(w).cast("long").alias("n")) for x, w in (("o", -1), ("n", 1))]
        out = sides[0].unionByName(sides[1])
        return out.groupBy("row_id", *columns).agg(F.sum("n").alias("n")).where("n <> 0")

    def apply(self, images: DataFrame, marker: dict, version: int) -> dict:
        more = {}
        for name, columns in (("queue", {"ts": self.table.time_column}), ("held", {"key": self.table.key_column, "place": self.table.order[0]})):
            if ledger := self.ledgers.get(name):
                rows = self.signed(images, **columns)
                more[name] = ledger.finish(marker.get(name, store.NEW), version, ledger.put(rows.where("ts is not null") if name == "queue" else rows, version))
        return more

    def dropped(self, changes: DataFrame, marker: dict, version: int) -> tuple[DataFrame, int | None]:
        """The changes with deletes of what the policy drops, and the reference time, which never goes back."""
        policy, last = self.policy, marker.get("reference")
        reference, ts = last, F.col(self.table.time_column)
        if policy.max_age_ms:
            changes = self.written(changes, version, "latest")  # which is looked at three times
            newest = changes.agg(F.max(ts)).first()[0]
            reference = R.reference_time(newest, last) if newest is not None else last
            if reference is not None:
                due = self.due(marker, version, last, reference).join(changes.select("row_id"), "row_id", "left_anti")
                late = F.coalesce(R.expired(ts, policy.max_age_ms, reference), F.lit(False))
                changes = changes.withColumn("op", F.when(late, C.DELETE).otherwise(F.col("op"))).unionByName(due.withColumn("op", F.lit(C.DELETE)), allowMissingColumns=True)
        if policy.max_rows or policy.max_rows_per_key:
            changes = self.store.put(changes, version)  # the table with them is looked at before some are taken back
            gone = self.too_many_per_key(changes, marker, version) if policy.max_rows_per_key else self.too_many(version)
            gone = self.written(gone, version)
            changes = self.written(changes.join(gone.select("row_id"), "row_id", "left_anti").unionByName(gone, allowMissingColumns=True), version, "retained")
        return changes, reference

    def written(self, df: DataFrame, version: int, what: str = "evicted") -> DataFrame:
        path = self.store.path(what, version)
        df.write.mode("overwrite").parquet(path)
        removed(self.store.spark, *([self.store.path(what, version - 1)] if version else []))
        return self.store.spark.read.schema(df.schema).parquet(path)

    def due(self, marker: dict, version: int, last: int | None, reference: int) -> DataFrame:
        """Row ids that the queue gives up between two reference times."""
        until = (reference - self.policy.max_age_ms) // self.queue.width
        since = until if last is None else (last - self.policy.max_age_ms) // self.queue.width
        rows = self.queue.state(marker.get("queue", store.NEW), version - 1, range(since, until + 1)) if last is not None else self.store.spark.createDataFrame([], self.queue.schema)
        return rows.where(R.expired(F.col("ts"), self.policy.max_age_ms, reference)).select("row_id").distinct()

    def too_many(self, version: int) -> DataFrame:
        state = self.store.state(version - 1, more=True)
        stay = R.newest(state, self.table.order[0], self.policy.max_rows, "row_id")
        return state.select("row_id").join(stay.select("row_id"), "row_id", "left_anti").select("row_id", F.lit(C.DELETE).alias("op"))

    def too_many_per_key(self, changes: DataFrame, marker: dict, version: int) -> DataFrame:
        """Of the keys that the batch gives rows to, those rows that are not among the newest any more."""
        images = self.store.imaged(changes, version)
        ours = self.signed(images, key=self.table.key_column, place=self.table.order[0])
        keys = ours.where("n > 0").select("key").distinct()
        buckets = [r[0] for r in keys.select(self.held.bucket(F.col("key"))).distinct().collect()]  # at most one row a bucket
        before = store.restricted(self.held.state(marker.get("held", store.NEW), version - 1, buckets), keys, ["key"])
        both = before.unionByName(store.restricted(ours, keys, ["key"]).select(*before.columns))
        now = both.groupBy("key", "row_id", "place").agg(F.sum("n").alias("n")).where("n > 0")
        stay = R.newest_per_key(now, "key", "place", self.policy.max_rows_per_key, "row_id")
        return now.join(stay.select("row_id"), "row_id", "left_anti").select("row_id", F.lit(C.DELETE).alias("op"))


@dataclass
class MaintainedJoin:
    """A many-to-one join of two maintained tables (J8), with grouped views and windows over it (J6). The right table is known by its row_id.

    refresh() joins again only the left rows of ids and keys that changed since the last one: the left table's images bring those that it changed,
    an index of left rows by join key tells the others, and of both tables the buckets of these rows are read. There is no version until both
    tables have one (J9). Rows: row_id of the left table, l and r (structs of the tables' columns, r null if nothing matches).
    What the left table's policy drops leaves the join and its views with the next refresh.
    """

    left: MaintainedTable
    right: MaintainedTable
    folder: str
    left_key: str
    how: str = "left"  # or inner
    views: Mapping[str, tuple[Sequence[str], Mapping[str, Measure]]] = field(default_factory=dict)  # keys and columns as l.x and r.y
    windows: Mapping[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        kind = lambda t: T.StructType([T.StructField(c, t.schema[c].dataType) for c in t.schema.names])
        id, spark = self.left.schema["row_id"], self.left.spark
        schema = T.StructType([id, T.StructField("l", kind(self.left)), T.StructField("r", kind(self.right))])
        self.store = Store(spark, self.folder, schema, self.left.buckets)
        self.derived = Derived(self.store, self.views, self.windows)
        by_key = T.StructType([T.StructField("key", self.left.schema[self.left_key].dataType), id, T.StructField("n", T.LongType())])
        self.index = Ledger(spark, f"{self.folder}/index", by_key, ["key", "row_id"], ["n"], ["key"], self.left.buckets)

    def written(self, df: DataFrame, what: str, version: int) -> DataFrame:
        path = self.store.path(what, version)
        df.write.mode("overwrite").parquet(path)
        return self.store.spark.read.schema(df.schema).parquet(path)

    def newest(self, since: int, until: int) -> DataFrame:
        """(row_id, l) of the left rows that these versions change, as the last of them leaves each; l is null of those that are gone."""
        if since == until:
            return self.left.store.images(since, until).select("row_id", F.col("n").alias("l"))
        each = [self.left.store.images(v, v).select("row_id", F.struct("n").alias("x"), F.lit(v).alias("version")) for v in range(since, until + 1)]
        return reduce(DataFrame.unionByName, each).groupBy("row_id").agg(F.max_by("x", "version").alias("x")).select("row_id", F.col("x.n").alias("l"))

    def rows_of(self, table: MaintainedTable, version: int, ids: DataFrame) -> DataFrame:
        """A table's rows of these row_ids, from the buckets that they lie in."""
        return table.store.state(version, buckets=self.buckets_of(table, ids)).join(ids, "row_id", "left_semi")

    def buckets_of(self, table: MaintainedTable, ids: DataFrame) -> list[int]:
        return [r[0] for r in ids.select(table.store.rows.bucket(F.col("row_id"))).distinct().collect()]  # at most one row a bucket

    def refresh(self) -> int | None:
        """The version after taking in what both tables have; None while one has nothing."""
        here, there = self.left.version(), self.right.version()
        if joins.ready_version(here if here >= 0 else None, there if there >= 0 else None) is None:
            return None
        last = self.store.version()
        marker, version = self.store.known(last), last + 1
        behind = last >= 0 and (here - marker["left"] >= store.KEPT or there - marker["right"] >= store.KEPT)  # images are not there for so long
        if last >= 0 and (here, there) == (marker["left"], marker["right"]):
            return last
        whole, key = F.struct(*self.left.schema.names).alias("l"), F.col(f"l.{self.left_key}")
        if last < 0 or behind:
            rows = self.left.store.state(here).select("row_id", whole)
            rows = self.written(rows.join(self.store.state(last).select("row_id"), "row_id", "full") if behind else rows, "left", version)
            indexed = self.index.state(marker.get("index", store.NEW), last) if behind else self.left.spark.createDataFrame([], self.index.schema)
            now = rows.where(key.isNotNull()).select(key.alias("key"), "row_id", F.lit(1).cast("long").alias("n"))
            entries = now.unionByName(indexed.withColumn("n", -F.col("n"))).groupBy("key", "row_id").agg(F.sum("n").alias("n")).where("n <> 0") if behind else now
        else:
            entries, parts = self.left.spark.createDataFrame([], self.index.schema), []
            if here > marker["left"]:
                images = self.left.store.images(marker["left"] + 1, here)
                parts.append(self.newest(marker["left"] + 1, here))
                sides = [images.where(f"{x}.{self.left_key} is not null").select(F.col(f"{x}.{self.left_key}").alias("key"), "row_id", F.lit(w).cast("long").alias("n")) for x, w in (("o", -1), ("n", 1))]
                entries = sides[0].unionByName(sides[1]).groupBy("key", "row_id").agg(F.sum("n").alias("n")).where("n <> 0")
            if there > marker["right"]:
                keys = self.right.store.images(marker["right"] + 1, there).select(F.col("row_id").cast(self.index.schema["key"].dataType).alias("key")).distinct()
                buckets = [r[0] for r in keys.select(self.index.bucket(F.col("key"))).distinct().collect()]
                held = store.restricted(self.index.state(marker["index"], last, buckets), keys, ["key"]).select("row_id")
                # rows that the left table changed come with its images; of the others, as they are, only those that these keys reach are read
                held = self.written(held.join(parts[0].select("row_id"), "row_id", "left_anti") if parts else held, "held", version)
                parts.append(self.rows_of(self.left, here, held).select("row_id", whole))
            rows = self.written(reduce(DataFrame.unionByName, parts), "left", version)
        wanted = rows.where(key.isNotNull()).select(key.cast(self.right.schema["row_id"].dataType).alias("row_id"))
        right = self.right.store.state(there, buckets=self.buckets_of(self.right, wanted)).select(F.struct(*self.right.schema.names).alias("r"))
        again = rows.join(right, key == F.col("r.row_id"), "left")
        gone = F.col("l").isNull() | F.col("r").isNull() if self.how == "inner" else F.col("l").isNull()
        changes = again.select("row_id", F.when(~gone, F.col("l")).alias("l"), F.when(~gone, F.col("r")).alias("r"), F.when(gone, C.DELETE).otherwise(C.UPSERT).alias("op"))
        images = self.store.imaged(self.store.put(changes, version), version)
        more = {"left": here, "right": there, "index": self.index.finish(marker.get("index", store.NEW), version, self.index.put(entries, version))}
        more |= self.derived.apply(images, version, marker)
        self.derived.finish(version, more, {"index": self.index}, ("left", "held"))
        return version

    def read(self, version: int, what: str = "table") -> DataFrame:
        """The joined rows or a grouped view at a version."""
        return self.store.state(version) if what == "table" else self.derived.read(what, version)

    def received(self, name: str, version: int) -> DataFrame:
        return self.derived.received(name, version)


def change_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1, format: str = "parquet", **options: str) -> DataFrame:
    """A stream of change files; format "kafka" works the same where Spark's Kafka package is installed."""
    return spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", files_per_batch).options(**options).load(path)
