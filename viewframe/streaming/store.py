"""Versioned keyed tables as bases and deltas, in files by hash bucket of the key.

A delta of a version holds what the version changes, either the last row per key (with op) or
amounts to be added up per key. The state at a version is the newest base at or before it with the deltas since laid over
it. A new base is written once the deltas have grown to a share of it, so a row is rewritten a bounded number of times.
Base and deltas lie in a folder per bucket: what asks for the rows of a batch's keys reads those buckets' files alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewframe.operators import changes as C
from viewframe.sources.scratch import removed

#: A base is written anew when the deltas since reach this share of its rows, or so many versions; the first one after so many deltas.
SHARE, MOST_VERSIONS, FIRST = 1.0, 16, 4
#: So many versions are kept for readers.
KEPT = 8
#: Buckets of a table by default: choose them so that one has about a task's share of rows.
BUCKETS = 4

NEW = {"base": -1, "base_rows": 0, "changed": 0}


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], others: Sequence[str]) -> Column:
    """left's keys equal to right's others, null to null."""
    out = F.lit(True)
    for k, o in zip(keys, others, strict=True):
        out = out & left[k].eqNullSafe(right[o])
    return out


def restricted(df: DataFrame, hit: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of df whose keys are in hit."""
    other = hit.select(*(F.col(k).alias(f"__h{i}") for i, k in enumerate(keys))).distinct()
    return df.join(other, null_safe(df, other, keys, [f"__h{i}" for i in range(len(keys))]), "left_semi")


class Ledger:
    """A keyed table. sums: columns whose amounts are added up per key; without them the last row per key counts, and its op.

    by: the keys that a bucket is chosen by. What a version's marker must say of a ledger is the `known` that finish() gives.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keys: Sequence[str], sums: Sequence[str] = (), by: Sequence[str] | None = None, buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.keys, self.sums, self.buckets = spark, folder, schema, list(keys), list(sums), buckets
        self.by = self.keys if by is None else list(by)
        extra = [] if sums else [T.StructField("op", T.StringType())]
        self.delta_schema = T.StructType([*schema.fields, *extra])

    def bucket(self, *columns: Column) -> Column:
        """The bucket of a row, or of these columns in the place of by."""
        columns = columns or tuple(F.col(f"`{c}`") for c in self.by)
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int") if columns else F.lit(0)

    def path(self, what: str, version: int) -> str:
        return f"{self.folder}/{what}/version={version}"

    def _fs(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def counted(self, df: DataFrame, path: str) -> int:
        """Writes df by buckets and gives the number of its rows, which the same job counts."""
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").partitionBy("bucket").parquet(path)
        return seen.get["rows"]

    def put(self, delta: DataFrame, version: int) -> int:
        return self.counted(delta.select(*self.delta_schema.names).withColumn("bucket", self.bucket()), self.path("delta", version))

    def touched(self, version: int) -> list[int]:
        """The buckets that a version changes, by the folders that it wrote."""
        path, fs = self._fs(self.path("delta", version))
        return sorted(int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(path) if s.getPath().getName().startswith("bucket="))

    def _read(self, what: str, versions: Iterable[int], schema: T.StructType, buckets: Sequence[int] | None) -> DataFrame:
        paths = [self.path(what, v) for v in versions]
        full = T.StructType([*schema.fields, T.StructField("version", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
        if not paths:
            return self.spark.createDataFrame([], full)
        df = self.spark.read.schema(full).option("basePath", f"{self.folder}/{what}").parquet(*paths)
        return df if buckets is None else df.where(F.col("bucket").isin(list(buckets)))

    def deltas(self, first: int, last: int, buckets: Sequence[int] | None = None) -> DataFrame:
        return self._read("delta", range(first, last + 1), self.delta_schema, buckets)

    def layers(self, known: dict, version: int, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of the newest base and of the deltas since, with op and version: what a key's last row is taken from."""
        base = known["base"]
        rows = self._read("base", [base] if base >= 0 else [], self.schema, buckets).withColumn("op", F.lit(C.UPSERT))
        over = self.deltas(max(base + 1, known.get("first", 0)), version, buckets)
        names = [*self.delta_schema.names, "version"]
        return over.select(*names) if base < 0 else rows.select(*names).unionByName(over.select(*names))

    def state(self, known: dict, version: int, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table at a version whose newest base is known's; only these buckets of it."""
        base = known["base"]
        rows = self._read("base", [base] if base >= 0 else [], self.schema, buckets)
        over = self.deltas(max(base + 1, known.get("first", 0)), version, buckets)  # first: of a ledger that began later than its table
        if base == version:
            return rows.select(*self.schema.names)
        if self.sums:
            both = rows.select(*self.schema.names).unionByName(over.select(*self.schema.names))
            kinds = {f.name: f.dataType for f in self.schema.fields}
            out = both.groupBy(*self.keys).agg(*(F.sum(s).cast(kinds[s]).alias(s) for s in self.sums))
            some = F.lit(False)
            for s in self.sums:
                some = some | (F.col(s) != 0)
            return out.where(some).select(*self.schema.names)
        others = [c for c in over.columns if c not in self.keys]
        last = over.groupBy(*self.keys).agg(F.max_by(F.struct(*others), "version").alias("x"))
        last = last.select(*self.keys, *(F.col(f"x.{c}").alias(c) for c in others)) if self.keys else last.where("x is not null").select("x.*")
        ids = last.select(*(F.col(k).alias(f"__h{i}") for i, k in enumerate(self.keys)))
        stay = rows.join(ids, null_safe(rows, ids, self.keys, ids.columns), "left_anti") if self.keys else rows.where(F.lit(last.isEmpty()))
        return stay.select(*self.schema.names).unionByName(last.where(F.col("op") == C.UPSERT).select(*self.schema.names))

    def finish(self, known: dict, version: int, changed: int) -> dict:
        """Perhaps a new base. What is known of the ledger from this version on."""
        changed += known["changed"]
        base = known["base"]
        due = version - known.get("first", 0) + 1 >= FIRST if base < 0 else changed > SHARE * known["base_rows"] or version - base >= MOST_VERSIONS
        if due:
            whole = self.state(known, version).withColumn("bucket", self.bucket())
            return {"base": version, "base_rows": self.counted(whole.repartition("bucket"), self.path("base", version)), "changed": 0}
        return known | {"changed": changed}

    def cleared(self, gone: int, needed: int) -> None:
        """Versions up to gone are read no more; needed: the base of the oldest one that still is."""
        first = max(0, gone - KEPT - MOST_VERSIONS - FIRST)
        removed(self.spark, *(self.path("delta", v) for v in range(first, gone + 1) if v <= needed), *(self.path("base", v) for v in range(first, gone + 1) if v < needed))


class Markers:
    """Versions that are whole: a small file each, written last and never twice."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _file(self, version: int):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/done/{version}.json")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version that was written whole, -1 if there is none."""
        path, fs = self._file(0)
        if not fs.exists(path.getParent()):
            return -1
        names = [s.getPath().getName() for s in fs.listStatus(path.getParent())]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=-1)

    def there(self, version: int) -> bool:
        """Whether a version is kept. The oldest one is gone already where a batch is given again that was marked as done."""
        path, fs = self._file(version)
        return fs.exists(path)

    def known(self, version: int) -> dict:
        """What a version's marker says."""
        path, fs = self._file(version)
        stream = fs.open(path)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def done(self, version: int, known: dict, overwrite: bool = False) -> None:
        """Marks a version as whole. Where two write the same version the file system lets one of them create it."""
        path, fs = self._file(version)
        stream = fs.create(path, overwrite)
        stream.write(bytearray(json.dumps(known).encode()))
        stream.close()

    def claim(self, version: int, owner: str) -> None:
        """Lets one of several writers go on to write a version; who claimed it may claim it again, anyone else is refused."""
        path, fs = self._file(version)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/claims/{version}")
        if self.version() >= version:
            raise ValueError(f"version {version} is there already")
        try:
            stream = fs.create(path, False)
        except Py4JJavaError:
            stream = fs.open(path)
            try:
                held = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
            finally:
                stream.close()
            if held != owner:
                raise ValueError(f"version {version} is being written by another writer") from None
            return
        stream.write(bytearray(owner.encode()))
        stream.close()

    def release(self, version: int) -> None:
        removed(self.spark, f"{self.folder}/claims/{version}")

    def forget(self, gone: int) -> None:
        removed(self.spark, f"{self.folder}/done/{gone}.json", f"{self.folder}/claims/{gone}")


class Store(Markers):
    """Versions of a table of rows, known by row_id: a ledger, the images before and after of what each version changed, markers."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, buckets: int = BUCKETS):
        super().__init__(spark, folder)
        self.schema = schema
        self.rows = Ledger(spark, f"{folder}/rows", schema, ["row_id"], buckets=buckets)
        self.columns = [c for c in schema.names if c != "row_id"]
        row = T.StructType([T.StructField(c, schema[c].dataType) for c in schema.names])
        self.change_schema = self.rows.delta_schema
        self.image_schema = T.StructType([schema["row_id"], T.StructField("o", row), T.StructField("n", row)])

    def path(self, what: str, version: int) -> str:
        return f"{self.folder}/{what}/version={version}"

    def known(self, version: int) -> dict:
        return super().known(version) if version >= 0 else {"rows": NEW}

    def state(self, version: int, more: bool = False, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table at a version, or these buckets of it; more: with the changes that the next version has put."""
        return self.rows.state(self.known(version)["rows"], version + more, buckets)

    def put(self, changes: DataFrame, version: int) -> DataFrame:
        self.changed = self.rows.put(changes, version)
        return self.rows.deltas(version, version).select(*self.change_schema.names)

    def imaged(self, changes: DataFrame, version: int) -> DataFrame:
        """Rows (row_id, o, n) of what a version changes, as a table of its own. Rows that stay as they are are left out.

        Only the buckets that the version touches are read.
        """
        names, at = self.schema.names, F.col("version")
        layers = self.rows.layers(self.known(version - 1)["rows"], version - 1, self.rows.touched(version))
        # what was and what is meet in one aggregation; of the table only the rows of the batch's ids get there
        both = layers.join(changes.select("row_id"), "row_id", "left_semi").unionByName(changes.withColumn("version", F.lit(version)))
        row = F.when(F.col("op") == C.UPSERT, F.struct(*names))
        was, is_ = F.max_by(row, F.when(at < version, at)), F.max_by(row, F.when(at == version, at))
        both = both.groupBy("row_id").agg(was.alias("o"), is_.alias("n"))
        both.where(~F.col("o").eqNullSafe(F.col("n"))).select("row_id", "o", "n").write.mode("overwrite").parquet(self.path("images", version))
        return self.images(version, version)

    def images(self, first: int, last: int) -> DataFrame:
        return self.spark.read.schema(self.image_schema).parquet(*(self.path("images", v) for v in range(first, last + 1)))

    def finish(self, version: int, more: dict, others: Sequence[tuple[str, Ledger]] = (), folders: Sequence[str] = (), again: bool = True) -> None:
        """Perhaps a new base; then the marker; then versions that nobody needs go. others: ledgers besides, by their name in the marker."""
        known = {"rows": self.rows.finish(self.known(version - 1)["rows"], version, self.changed)} | more
        self.done(version, known, again)
        if (gone := version - KEPT) >= 0:
            oldest = self.known(gone + 1)  # of the oldest version that is kept
            self.rows.cleared(gone, oldest["rows"]["base"])
            for name, ledger in others:
                if name in oldest:
                    ledger.cleared(gone, oldest[name]["base"])
            removed(self.spark, *(self.path(what, gone) for what in ("images", *folders)))
            self.forget(gone)
