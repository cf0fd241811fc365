"""Rows known by keyed state: the latest image of each row in RocksDB, with a timer for its age.

What a batch costs follows its keys: each is looked up and written in the state of its task, no table is read. A row's old
and new image come out, of which the table's changes, its views and joins are made as of any others (tables.py).
Ages go by event time: a row leaves with the first batch after the one whose newest time makes it due, and one that
comes when it is due already does not come in. State is changelogged to the checkpoint, so a lost executor loses none.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from viewframe.operators import changes as C

if TYPE_CHECKING:
    from viewframe.streaming.tables import MaintainedTable

SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class LatestRow(StatefulProcessor):
    """Per row_id its columns; a time column and an age, if rows expire."""

    def __init__(self, columns: list[str], schema: str, order: list[str], time_column: str | None, max_age_ms: int | None):
        self.columns, self.schema, self.order, self.time_column, self.max_age_ms = columns, schema, order, time_column, max_age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.row = handle, handle.getValueState("row", self.schema)

    def image(self, id: Any, values: tuple | None) -> dict | None:
        return None if values is None else {"row_id": id, **dict(zip(self.columns, values, strict=True))}

    def due(self, values: tuple, now: int) -> bool:
        ts = values[self.columns.index(self.time_column)] if self.max_age_ms else None
        return ts is not None and ts + self.max_age_ms <= now

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last = max(rows, key=lambda r: tuple(r[c] for c in self.order))
        held = self.row.get()
        old = tuple(held) if held is not None else None
        new = None if last["op"] == C.DELETE else tuple(last[c] for c in self.columns)
        if self.max_age_ms and new is not None and self.due(new, timerValues.getCurrentWatermarkInMs()):
            new = None
        if new == old:
            return
        if new is None:
            self.row.clear()
        else:
            self.row.update(new)
            if self.max_age_ms and (ts := new[self.columns.index(self.time_column)]) is not None:
                self.handle.registerTimer(ts + self.max_age_ms)
        yield Row(row_id=key[0], o=self.image(key[0], old), n=self.image(key[0], new))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        held = self.row.get()
        if held is not None and self.due(tuple(held), expiredTimerInfo.getExpiryTimeInMs()):  # else it has been renewed since
            self.row.clear()
            yield Row(row_id=key[0], o=self.image(key[0], tuple(held)), n=None)

    def close(self) -> None:
        pass


def images(table: MaintainedTable, stream: DataFrame) -> DataFrame:
    """The stream of (row_id, o, n) that a stream of changes leads to."""
    names = [c for c in table.schema.names if c != "row_id"]
    payload = T.StructType([table.schema[c] for c in names])
    age = table.policy.max_age_ms if table.policy else None
    if age:
        stream = stream.withColumn("__time", F.timestamp_millis(table.time_column)).withWatermark("__time", "0 seconds")
    processor = LatestRow(names, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in payload.fields), list(table.order), table.time_column if age else None, age)
    keyed = stream.select("row_id", "op", *dict.fromkeys([*table.order, *names]), *(["__time"] if age else [])).groupBy("row_id")
    return keyed.transformWithState(processor, table.store.image_schema, "Update", "EventTime" if age else "None")


def run(table: MaintainedTable, stream: DataFrame, checkpoint: str):
    """Streams all changes that are there through the state, a version a micro-batch."""
    spark = table.spark
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        query = images(table, stream).writeStream.outputMode("update").foreachBatch(table.apply_images).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return query
