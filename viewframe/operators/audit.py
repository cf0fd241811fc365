"""Digests, completeness checks, observations and lag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewframe.operators.order import ranked

BLOCK = 4096


def row_digest(columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def table_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (rows, digest): XOR of the rows' SHA-256, in any order (Q1)."""
    return digest_of(df.select(row_digest(columns).alias("__d")), "__d")


def digest_of(df: DataFrame, digest: str) -> DataFrame:
    """XOR of a column of SHA-256 texts, in eight slices of 32 bits."""
    parts = [F.coalesce(F.bit_xor(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")), F.lit(0)) for k in range(8)]
    return df.agg(F.count("*").alias("rows"), F.concat(*(F.lpad(F.lower(F.hex(p)), 8, "0") for p in parts)).alias("digest"))


def updated_digest(old: str, removed: DataFrame, added: DataFrame, columns: Sequence[str]) -> str:
    """A digest after rows left and came: XOR is its own inverse."""
    out = int(old, 16)
    for df in (removed, added):
        out ^= int(table_digest(df, columns).first()["digest"], 16)
    return f"{out:064x}"


def ordered_hash(df: DataFrame, id: str, key: str, columns: Sequence[str]) -> DataFrame:
    """Hash of the rows in the order of ids (Q2): the hashes of blocks of BLOCK rows, each of its rows' hashes one a line, hashed again.

    Ids are sorted as texts, by ranges of which no task holds more than one; a block is BLOCK digests. Blocks of blocks follow
    until one is left, so nothing grows with the table but the number of rounds.
    """
    line = F.sha2(F.concat_ws("\t", F.col(id).cast("string"), F.col(key).cast("string"), F.to_json(F.struct(*columns))), 256)
    rows = df.select(F.col(id).cast("string").alias("id"), line.alias("h"))
    rows = ranked(rows, [F.col("id").asc(), F.col("h").asc()]).select(F.col("__rank").alias("at"), "h")
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), "\n")  # of a block
    left = df.count()
    while True:
        rows = rows.groupBy(F.floor(F.col("at") / BLOCK).alias("block")).agg(F.sha2(lines, 256).alias("h")).select(F.col("block").alias("at"), "h")
        left = -(-left // BLOCK)
        if left <= 1:
            return rows.select(F.col("h").alias("hash"))


def completeness(source: DataFrame, copy: DataFrame, columns: Sequence[str], id: str = "row_id") -> DataFrame:
    """(id, finding): missing, extra or different rows of a copy (Q3)."""
    a = source.select(F.col(id), F.struct(*columns).alias("s"))
    b = copy.select(F.col(id).alias("__id"), F.struct(*columns).alias("c"))
    both = a.join(b, F.col(id) == F.col("__id"), "full_outer")
    finding = F.when(F.col("__id").isNull(), "missing").when(F.col(id).isNull(), "extra").when(~F.col("s").eqNullSafe(F.col("c")), "different")
    return both.select(F.coalesce(id, "__id").alias(id), finding.alias("finding")).where("finding is not null")


def observed(df: DataFrame, ids: DataFrame, id: str = "row_id") -> DataFrame:
    """The rows of chosen ids, absent ones included (Q4); present tells them apart."""
    marked = df.withColumn("present", F.lit(True))
    return ids.select(id).distinct().join(marked, id, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def lag_table(progress: DataFrame) -> DataFrame:
    """Per partition lag = readable_end - serving_next, and whether what is derived has caught up with what is durable (Q5)."""
    return progress.withColumn("lag", F.col("readable_end") - F.col("serving_next")).withColumn("caught_up", F.col("derived_next") == F.col("durable_next"))


def disagreements(maintained: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows that only one of a maintained and a recomputed view has, repeats counted (Q6)."""
    columns = maintained.columns
    a = maintained.exceptAll(recomputed.select(*columns)).withColumn("only_in", F.lit("maintained"))
    return a.unionByName(recomputed.select(*columns).exceptAll(maintained).withColumn("only_in", F.lit("recomputed")))
