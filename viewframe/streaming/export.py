"""A maintained table's complete export (S13): a snapshot, then an epoch for each version, read back to the table at any of them.

The sink has a folder per epoch, and a manifest per epoch that is written last: readers see whole epochs only, and an
export that stopped goes on after its newest manifest. An epoch has one final change per row with the
row's columns, deletes before upserts. An epoch whose changes the table does not keep any more is a loss and is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewframe.operators import changes as C
from viewframe.streaming import store
from viewframe.streaming.store import Markers, Store


class Export:
    def __init__(self, source: Store, folder: str):
        self.source, self.folder, self.manifests = source, folder, Markers(source.spark, folder)
        self.schema = T.StructType([*source.schema.fields, T.StructField("op", T.StringType()), T.StructField("rank", T.IntegerType())])

    def _written(self, rows: DataFrame, epoch: int, kind: str) -> None:
        path = f"{self.folder}/epochs/epoch={epoch}"
        rank = F.when(F.col("op") == C.DELETE, 0).otherwise(1)
        ordered = rows.withColumn("rank", rank).select(*self.schema.names).repartitionByRange("rank", "row_id").sortWithinPartitions("rank", "row_id")
        ordered.write.mode("overwrite").parquet(path)
        counts = {r["op"]: r["count"] for r in self.source.spark.read.schema(self.schema).parquet(path).groupBy("op").count().collect()}
        self.manifests.done(epoch, {"kind": kind, "upserts": counts.get(C.UPSERT, 0), "deletes": counts.get(C.DELETE, 0)}, overwrite=True)

    def open(self) -> int:
        """The snapshot at the table's newest version, once; the epoch that it is."""
        if self.manifests.version() >= 0:
            return self.manifests.version()
        cut = self.source.version()
        if cut < 0:
            raise ValueError("there is no version to export yet")
        self._written(self.source.state(cut).withColumn("op", F.lit(C.UPSERT)), cut, "snapshot")
        return cut

    def advance(self) -> list[int]:
        """Exports the versions since; which they were."""
        last, newest = self.open(), self.source.version()
        if newest - last > store.KEPT:
            raise ValueError("the table does not keep what followed the export any more")
        for epoch in range(last + 1, newest + 1):
            images = self.source.images(epoch, epoch)
            columns = [F.col(f"n.{c}").alias(c) for c in self.source.columns]
            self._written(images.select("row_id", *columns, F.when(F.col("n").isNull(), C.DELETE).otherwise(C.UPSERT).alias("op")), epoch, "epoch")
        return list(range(last + 1, newest + 1))

    def epochs(self) -> DataFrame:
        """All changes of the sink with their epoch."""
        schema = T.StructType([*self.schema.fields, T.StructField("epoch", T.IntegerType())])
        whole = self.manifests.version()
        return self.source.spark.read.schema(schema).parquet(f"{self.folder}/epochs").where(F.col("epoch") <= whole)

    def restored(self, epoch: int) -> DataFrame:
        """The table at an epoch, from the sink alone."""
        return C.folded(self.epochs().where(F.col("epoch") <= epoch), order=("epoch",)).select(*self.source.schema.names)
