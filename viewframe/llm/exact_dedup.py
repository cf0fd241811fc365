"""Operator 5: exact dedup by stateful streaming over disk-backed keyed state.

A narrow table of (digest, stable identifier, content locator) is landed in the shared folder and
streamed through a stateful aggregation keyed by digest. The state lives in RocksDB, has no
watermark and so never expires; for each digest it retains the smallest identifier, the locator
of that row and the number of rows. Digests seen more than once are hits, and for these the full
normalised bytes are compared: texts that share a digest but differ form groups of their own.

Defined results: a null text counts as empty and an empty text is a text like any other; a null
identifier, of any type that has an order, sorts after all others; of rows that repeat both identifier and text exactly one is
kept (the first landed); an empty table gives an empty result; columns besides identifier and
text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viewframe.llm.common import SPACE, attach, free, is_small, scratch, table, text_of, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(normal: Column) -> Column:
    return F.sha2(normal, 256)


def normalised(text: str) -> Column:
    return F.regexp_replace(text_of(text), SPACE, " ")


class DedupStore:
    """Keyed state that lasts over loads. load() lands rows, advance() streams what has been landed.

    id_type: of the identifiers, any type that has an order. texts: keep the normalised texts of what is landed, so that
    a hit can be compared with the content that its digest's locator (load and row) points at, loads ago.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, digest: Callable[[Column], Column] = sha256, files_per_batch: int = 1000, id_type: str = "long", texts: bool = False):
        self.spark, self.digest, self.files, self.texts = spark, digest, files_per_batch, texts
        self.folder, self.loads = folder or scratch(spark, "dedup"), 0
        self.keys = f"id {id_type}, digest string, load int, row long"
        self.first = f"struct<no_id boolean, id {id_type}, load int, row long>"

    def keyed(self, docs: DataFrame, id: str, text: str) -> DataFrame:
        normal = normalised(text)
        return docs.select(F.col(id).alias("id"), normal.alias("normal"), F.monotonically_increasing_id().alias("row")).withColumn("digest", self.digest(F.col("normal")))

    def load(self, docs: DataFrame, id: str = "doc_id", text: str = "text") -> None:
        keys = self.keyed(docs, id, text).withColumn("load", F.lit(self.loads))
        if self.texts:  # numbers and texts come of one table
            keys.write.mode("overwrite").parquet(f"{self.folder}/texts/part={self.loads}")
            keys = self.spark.read.parquet(f"{self.folder}/texts/part={self.loads}")
        keys.select("id", "digest", "load", "row").write.mode("append").parquet(f"{self.folder}/landed")
        self.loads += 1

    def clashes(self) -> DataFrame:
        """Digests under which a landed text differs from the one that the state's locator points at, byte by byte."""
        held = self.spark.read.schema(f"{self.keys}, normal string").parquet(f"{self.folder}/texts")
        first = written(self.state().where("count > 1").select("digest", F.col("first.load").alias("load"), F.col("first.row").alias("row")), "located")
        located = written(held.join(first, ["digest", "load", "row"]).select(F.col("digest"), F.col("normal").alias("of_first")), "located")
        return attach(held.select("digest", "normal"), located, "digest").where("normal <> of_first").select("digest").distinct()

    def advance(self) -> None:
        changes = f"{self.folder}/changes"

        def upsert(batch: DataFrame, number: int) -> None:
            # overwriting the batch's own folder makes a repeated batch harmless
            batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

        settings = {
            "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
            "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
            "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
            "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
            "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # a store is opened once a batch and needs no memory in between
            "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores would hold megabytes of empty log each
        }
        before = {k: self.spark.conf.get(k, None) for k in settings}
        for k, v in settings.items():
            self.spark.conf.set(k, v)
        try:
            landed = self.spark.readStream.schema(self.keys).option("maxFilesPerTrigger", self.files).parquet(f"{self.folder}/landed")
            state = landed.groupBy("digest").agg(F.min(self.order()).alias("first"), F.count("*").alias("count"))
            query = (
                state.writeStream.outputMode("update").foreachBatch(upsert)
                .option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
            )
            query.awaitTermination()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    @staticmethod
    def order() -> Column:
        return F.struct(F.col("id").isNull().alias("no_id"), "id", "load", "row")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.keys).parquet(f"{self.folder}/landed")

    def state(self) -> DataFrame:
        """One row per digest: first (no_id, id, load, row) and count. Later batches supersede earlier ones."""
        schema = f"digest string, first {self.first}, count long, batch int"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/changes").groupBy("digest").agg(F.min("first").alias("first"), F.max("count").alias("count"))


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of docs: id, digest, keep_id, group_size, kept, first_row, row.

    The hot digest of a large group of copies meets its state row in a join that Spark's skew
    handling may split; everything before that is combined map-side.
    """
    spark = docs.sparkSession
    store = DedupStore(spark, digest=digest, id_type=docs.schema[id].dataType.simpleString())
    store.load(docs, id, text)
    store.advance()
    # a table of its own: were the aggregation part of the join below, Spark could not split a hot digest's rows
    rows, state = store.rows(), written(store.state(), "state")
    plain = rows.join(state, "digest").select(
        "id", "digest", F.col("first.id").alias("keep_id"), F.col("count").alias("group_size"),
        ((F.col("first.load") == F.col("load")) & (F.col("first.row") == F.col("row"))).alias("kept"), "row",
    )
    hits = state.where("count > 1").select("digest")
    keyed = store.keyed(docs, id, text)
    hit_texts = attach(keyed, hits, "digest", "left_semi")
    classes = hit_texts.groupBy("digest", "normal").agg(F.count("*").alias("n"))  # full bytes, copies combined map-side
    clashes = classes.groupBy("digest").agg(F.count("*").alias("classes")).where("classes > 1").select("digest")
    if clashes.isEmpty():
        return plain
    mixed = written(keyed.join(clashes, "digest", "left_semi").withColumn("load", F.lit(0)), "clashes")  # keeps its row numbers
    groups = mixed.groupBy("digest", "normal").agg(F.min(DedupStore.order()).alias("first"), F.count("*").alias("group_size"))
    exact = mixed.join(groups, ["digest", "normal"]).select(
        "id", "digest", F.col("first.id").alias("keep_id"), "group_size", (F.col("first.row") == F.col("row")).alias("kept"), "row",
    )
    return plain.join(clashes, "digest", "left_anti").unionByName(exact)


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that repeat another one's normalised text; all columns stay."""
    groups = written(exact_groups(docs, id, text), "groups")
    as_key, as_digest = free(docs, "__id", "__digest")
    gone = groups.where("not kept").select(F.col("id").alias(as_key), F.col("digest").alias(as_digest))
    held = groups.where("kept").select(F.col("id").alias("held_id"), F.col("digest").alias("held_digest"))
    # ids that are unique within a digest need no more than an anti join; repeated rows keep one of them
    twice = gone.join(held, gone[as_key].eqNullSafe(held["held_id"]) & (gone[as_digest] == held["held_digest"]), "left_semi")
    own, = free(docs, "__normal_digest")
    marked = docs.withColumn(own, sha256(normalised(text)))
    same = lambda right: marked[id].eqNullSafe(right[as_key]) & (marked[own] == right[as_digest])
    rest = marked.join(F.broadcast(gone) if is_small(gone) else gone, same(gone), "left_anti")
    if twice.isEmpty():
        return rest.drop(own)
    again = marked.join(twice.distinct(), same(twice), "left_semi").dropDuplicates([id, own])
    return rest.unionByName(again).drop(own)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP5_SQL = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
g as (select t, min(doc_id) as keep_id, count(*) as group_size from n group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from n join g using (t)
"""
