"""Operator 9: SimHash near-dedup by pivot distance tables.

Distinct fingerprints are dealt into buckets in which some links must fall: 64 bits are cut into
BLOCKS blocks, LINK differing bits leave BLOCKS - LINK blocks untouched, so two linked fingerprints
agree on at least one choice of so many blocks. In a bucket each fingerprint has a row of Hamming
distances to PIVOTS reference fingerprints. By the triangle inequality a pair whose rows differ
by more than LINK at any pivot is no link: the first pivot's coordinate, by which a bucket is sorted, finds the
pairs to look at, the others discard; what survives is verified on the fingerprints
themselves. A bucket hands on a spanning forest of its links, never all pairs. Buckets with more
than HOT fingerprints are dealt once more by blocks of their open bits; what is crowded even then has at most as many
fingerprints as some 16 bits tell apart, and is cut into parts whose pairs of parts go to tasks of their own.

Components are found by rounds of the smallest label over links with shortcuts, in joins and
aggregates; each round is a table in the shared folder.

Defined results: a null text counts as empty; texts without words have fingerprint zero and link
like any other; repeated rows share a fingerprint and a component; a component's id is its
smallest doc_id, null only if all are null; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewframe.llm.common import dropped, free, is_small, released, small_batches, table, written

BLOCKS, LINK, SHINGLE, SEED = 6, 3, 3, 42
PIVOTS, HOT = 24, 20_000

# ---- fingerprints ---------------------------------------------------------------------------


def fingerprint(text: bytes) -> int:
    """Majority of the bits of the hashes of all 3-word shingles, A-Z lower-cased."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    n = len(words)
    if not n:
        return 0
    if n <= SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False)))
    seeds = [SEED] * len(shingles)
    counts, step = np.zeros(64, np.int64), 1 << 16
    for k in range(0, len(shingles), step):
        part = shingles[k : k + step]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, part, seeds), np.uint64, len(part))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(shingles), bitorder="little")
    return int(bits.view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])
        released()

    small_batches(docs.sparkSession)
    return docs.select(id, text).mapInArrow(run, f"id {docs.schema[id].dataType.simpleString()}, fp long")


# ---- links ----------------------------------------------------------------------------------


def pivots(n: int = PIVOTS, seed: int = 9) -> np.ndarray:
    """Reference fingerprints. Pairs of a random one and its copy with one block inverted: their
    distances tell about that block, so bits that a bucket leaves open are told apart well."""
    rng = np.random.default_rng(seed)
    out = rng.integers(0, 1 << 64, n, dtype=np.uint64)
    for k in range(1, n, 2):
        lo = 64 * (k // 2) // (n // 2)
        hi = 64 * (k // 2 + 1) // (n // 2)
        out[k] = out[k - 1] ^ np.uint64(((1 << (hi - lo)) - 1) << lo)
    return out


def distance_table(fps: np.ndarray, references: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ references[None, :]).astype(np.int8)


def masks(blocks: int = BLOCKS, link: int = LINK) -> list[int]:
    """The bits of each choice of blocks - link blocks."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(one, blocks - link)]


class Forest:
    """Union of rows of one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = k = self.up[self.up[k]]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def linked(fps: np.ndarray, first: np.ndarray, last: np.ndarray, link: int = LINK) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows: row k is compared with rows first[k] to last[k] - 1. Pairs are made a bounded number at a time."""
    references = pivots()
    rows = distance_table(fps, references)
    many = np.maximum(last - first, 0)
    total = np.concatenate([[0], np.cumsum(many)])
    forest, out_a, out_b, step = Forest(len(fps)), [], [], 1 << 20
    for begin in range(0, int(total[-1]), step):
        pair = np.arange(begin, min(begin + step, int(total[-1])))
        a = np.searchsorted(total, pair, side="right") - 1
        b = first[a] + (pair - total[a])
        for k in range(1, len(references)):  # discarded at the first pivot that tells them apart; the rows were found by the first one
            near = np.abs(rows[a, k] - rows[b, k]) <= link
            a, b = a[near], b[near]
        sure = np.bitwise_count(fps[a] ^ fps[b]) <= link
        for x, y in zip(a[sure].tolist(), b[sure].tolist(), strict=True):
            if forest.join(x, y):
                out_a.append(x)
                out_b.append(y)
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


def in_reach(group: np.ndarray, crossed: np.ndarray, side: np.ndarray, distance: np.ndarray, link: int = LINK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of rows, and per row of it the range of rows whose distance to the first pivot is at most link from its own.

    Rows of a group are compared with each other, each pair once; in a crossed group those of side 0 with those of side 1.
    """
    shelf = 2 * group + (crossed & (side == 1))
    order = np.argsort(shelf * 128 + distance, kind="stable")
    shelf, distance, crossed, side = shelf[order], distance[order].astype(np.int64), crossed[order], side[order]
    key = shelf * 128 + distance
    other = shelf + (crossed & (side == 0))
    first = np.where(crossed, np.searchsorted(key, other * 128 + np.maximum(distance - link, 0)), np.arange(len(key)) + 1)
    last = np.searchsorted(key, other * 128 + distance + link, side="right")
    return order, first, np.where(crossed & (side == 1), first, last)


def bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input sorted by (bucket, part_a, part_b, side): rows of one bucket stand together. In a pair of different
    parts the rows of side 0 are compared with those of side 1, else all rows with each other."""
    held: list[pa.Table] = []

    def links(t: pa.Table) -> pa.RecordBatch:
        fps = t["fp"].to_numpy().view(np.uint64)
        keys = np.stack([t[c].to_numpy() for c in ("mask", "bucket", "part_a", "part_b")])
        new = np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
        order, first, last = in_reach(np.cumsum(new), keys[2] != keys[3], t["side"].to_numpy(), distance_table(fps, pivots()[:1])[:, 0])
        fps = fps[order]
        a, b = linked(fps, first, last)
        return pa.RecordBatch.from_arrays([pa.array(fps[a].view(np.int64)), pa.array(fps[b].view(np.int64))], ["a", "b"])

    rows = 0
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held.append(t)
        rows += len(t)
        if rows < 200_000:
            continue
        whole = pa.concat_tables(held)
        keys = [whole[c].to_numpy() for c in ("mask", "bucket", "part_a", "part_b")]
        other = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))  # the last bucket may go on
        if not len(other):
            continue
        cut = int(other[-1]) + 1
        yield links(whole.slice(0, cut))
        held, rows = [whole.slice(cut)], len(whole) - cut
    if rows:
        yield links(pa.concat_tables(held))


def finer(mask: int, blocks: int = BLOCKS, link: int = LINK) -> list[int]:
    """Masks that hold this one's bits and each choice of blocks - link blocks of its open bits."""
    free_bits = [k for k in range(64) if not mask >> k & 1]
    cuts = [len(free_bits) * k // blocks for k in range(blocks + 1)]
    one = [sum(1 << k for k in free_bits[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
    return [mask | sum(c) for c in combinations(one, blocks - link)]


def dealt(rows: DataFrame, choices: Column) -> tuple[DataFrame, DataFrame]:
    """Rows (fp, mask, bucket, n) of buckets with two fingerprints or more, and the table (mask, bucket, n) that they were met with.

    choices: array of (mask number, bits) that a row is dealt by. As the counts are a table, Spark may split a crowded bucket.
    """
    keyed = rows.select("fp", F.explode(choices).alias("o")).select("fp", "o.mask", F.col("fp").bitwiseAND(F.col("o.bits")).alias("bucket"))
    full = written(keyed.groupBy("mask", "bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    return keyed.join(full, ["mask", "bucket"]), full


def candidate_rows(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Rows (mask, bucket, part_a, part_b, side, fp), only of buckets with two fingerprints or more.

    A crowded bucket's fingerprints are dealt again by blocks of the bits that it leaves open, which holds all its links by the same
    count of blocks. About 16 bits are open then, so no bucket has more fingerprints than these can tell apart; parts are of those.
    """
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m)
    choice = lambda k, m: F.struct(F.lit(k).alias("mask"), signed(m).alias("bits"))
    first = masks()
    sized, full = dealt(fps, F.array(*(choice(k, m) for k, m in enumerate(first))))
    if not full.where(F.col("n") > hot).isEmpty():
        each = len(first)
        again = F.array(*(F.array(*(choice(each * (k + 1) + j, x) for j, x in enumerate(finer(m)))) for k, m in enumerate(first)))
        deeper, _ = dealt(sized.where(F.col("n") > hot), F.element_at(again, F.col("mask") + 1))
        sized = sized.where(F.col("n") <= hot).unionByName(deeper)
    parts = F.ceil(F.col("n") / F.lit(hot)).cast("int")
    own = F.pmod(F.xxhash64("fp", "mask"), parts).cast("int")
    sized = sized.withColumn("parts", parts).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return sized.select(
        "mask", "bucket", F.least("own", "other").alias("part_a"), F.greatest("own", "other").alias("part_b"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "fp",
    )


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """fps: distinct fp. Rows (a, b): a spanning forest of each bucket's links."""
    rows = candidate_rows(fps, hot).repartition("mask", "bucket", "part_a", "part_b")
    rows = rows.sortWithinPartitions("mask", "bucket", "part_a", "part_b", "side")
    return rows.mapInArrow(bucket_links, "a long, b long")


# ---- components -----------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for each node of edges (a, b): the smallest node of its component."""
    both = written(edges.union(edges.select("b", "a")).where("a != b").distinct().toDF("node", "near"), "links")
    labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("root")), "labels")
    while True:
        # a node takes the smallest label around it, and the label of its label
        seen = both.join(labels.toDF("near", "label"), "near").groupBy("node").agg(F.min("label").alias("label"))
        lower = labels.join(seen, "node").select("node", "root", F.least("root", "label").alias("new"))
        # whoever points at a node that now knows better hands that on to it as well, so long chains shrink fast
        handed = lower.groupBy(F.col("root").alias("node")).agg(F.min("new").alias("handed"))
        told = lower.join(handed, "node", "left").select("node", "root", F.least("new", F.coalesce("handed", "new")).alias("new"))
        told = written(told, "told")
        jump = told.select(F.col("node").alias("new"), F.col("new").alias("beyond"))
        after = written(told.join(jump, "new", "left").select("node", F.least("new", F.coalesce("beyond", "new")).alias("root"), F.col("root").alias("old")), "labels")
        moving = not after.where("root != old").isEmpty()
        dropped(told)
        dropped(labels)
        labels = after.select("node", "root")
        if not moving:
            dropped(both)
            return labels


def grouped(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """prints: id, fp per row. One row per row with component_id and first, the id and fp of the row that stands
    for the component. The hot fingerprint of many copies is combined map-side; the last join is one
    whose skew Spark may split."""
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    labels = components(links(distinct.select("fp"), hot))
    rooted = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("no_id"), F.col("least").alias("id"), "fp")).alias("first"))
    known = written(rooted.join(smallest, "root").select("fp", "first"), "known")
    return prints.join(known, "fp").withColumn("component_id", F.col("first.id"))


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, fingerprint, component_id."""
    prints = written(with_fingerprints(docs, id, text), "fingerprints")
    return grouped(prints).select("id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near copies, the one with the smallest id; all columns stay.

    Rows that repeat both the id and the fingerprint of that one are the same document given
    again; one of them stays, as does one row of a group without any id.
    """
    own, as_id, as_print = free(docs, "__fp", "__id", "__print")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), np.uint64, len(texts))
            yield batch.append_column(own, pa.array(found.view(np.int64)))
        released()

    small_batches(docs.sparkSession)
    # texts are written with their fingerprints, which cost more than a copy
    marked = written(docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(own, T.LongType())])), "marked")
    groups = written(grouped(marked.select(F.col(id).alias("id"), F.col(own).alias("fp"))), "groups")
    stands = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("fp") == F.col("first.fp"))
    keys = F.col("id").alias(as_id), F.col("fp").alias(as_print)
    gone = groups.where(~stands).select(*keys)
    twice = groups.where(stands).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    same = lambda right: marked[id].eqNullSafe(right[as_id]) & (marked[own] == right[as_print])
    gone = written(gone.unionByName(twice), "gone")
    kept = marked.join(F.broadcast(gone) if is_small(gone) else gone, same(gone), "left_anti")
    if not twice.isEmpty():
        again = marked.join(twice, same(twice), "left_semi").dropDuplicates([id, own])
        kept = kept.unionByName(again)
    return kept.drop(own)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
