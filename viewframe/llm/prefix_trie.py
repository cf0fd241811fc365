"""Operator 13: the prefix trie of conversations, by count-min screening of prefix digests.

Every prefix of a conversation's turns has a digest: the sums of two lanes of 60 bits of SHA-256 of its
turns' places and of what they say. Each task counts the digests of its rows in a count-min sketch of
bounded size; the sketches are added up and sent to all tasks. An estimate of one proves that no
other conversation starts so, and neither with anything longer: such tails are nodes of one member
each and are given out where they are. Only prefixes that may be shared are shuffled by their digests
and grouped exactly.

Nothing walks the trie level by level. The smallest member of a node stands for it; what a node says of
its subtree (leaves, saved tokens, children) is put down at the row of the standing conversation, summed
from there to the conversation's end, and added up over a node's members. Numbers along a conversation are
running sums over ranges of rows, so a conversation of any length has many tasks.

Defined results: a null role or text is the empty one; rows of null conv_id belong to no conversation and are left out; equal
turns stand by role and text; an empty table has no node, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewframe.llm.common import WORD, attach, is_small, small_batches, table, unsent, written

#: A conversation is rebuilt on the first turns of the first one of its group of so many.
GROUP, HEADS = 20, 4
#: Counters of a row of the sketch, at least and at most, per prefix, and rows. Beyond the most, more prefixes go the exact way.
LEAST_BITS, MOST_BITS, PER_PREFIX, SKETCH_ROWS = 12, 24, 4, 2
#: Characters of a chunk of member ids that is hashed at a time.
CHUNK = 4096
#: Characters of a role and of a text by which turns of one number are dealt: the driver gets a sample of what rows are dealt by.
BEGINNING = 128
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def running(df: DataFrame, group: str, order: Sequence[Column], sums: dict[str, Column], what: str, by: Sequence[Column] | None = None, without: Sequence[str] = ()) -> DataFrame:
    """df with sums of longs, modulo 2^64, each from the start of the row's group up to it; order must tell the rows of a group apart.

    Rows are dealt by ranges of group and order and summed where they are. by: columns that never fall where order rises, to deal rows
    by instead, if those of order are long. without: columns of df that are not wanted beyond the order. What a range hands on to the next is one row, of the group
    that it ends with; the driver adds those rows up, one per task.
    """
    spark, names = df.sparkSession, list(sums)
    valued = df.select("*", *(c.cast("long").alias(n) for n, c in sums.items()))
    valued_out = valued.drop(*without)
    all_names = valued_out.columns
    at, group_at = [all_names.index(n) for n in names], all_names.index(group)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, last, held = TaskContext.get().partitionId(), 0, None, np.zeros(len(at), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            groups = batch.column(group_at).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[groups[0] != last or not seen], groups[1:] != groups[:-1]]))
            columns = list(batch.columns)
            which = np.searchsorted(starts, np.arange(n), side="right") - 1  # -1: of the group that the batch before ended with
            for k, c in enumerate(at):
                total = np.cumsum(batch.column(c).to_numpy(zero_copy_only=False))
                before = np.concatenate([[0], total])[starts]
                own = total - np.where(which >= 0, before[which] if len(starts) else 0, -held[k])
                columns[c], held[k] = pa.array(own), own[-1]
            last = groups[-1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n))], [*all_names, "__part", "__seq"])
            seen += n

    schema = T.StructType([*valued_out.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__seq", T.LongType())])
    dealt = valued.repartitionByRange(F.col(group), *(by or order)).sortWithinPartitions(F.col(group), *order).drop(*without)
    table = written(dealt.mapInArrow(inside, schema), what)
    edges = table.groupBy("__part").agg(F.min(group).alias("first"), F.max_by(F.struct(group, *names), "__seq").alias("last")).orderBy("__part").collect()
    handed, open_group, carry = {}, None, np.zeros(len(names), np.int64)
    for e in edges:
        if open_group == e["first"]:
            handed[e["__part"]] = (e["first"], carry.copy())
        own = np.array([e["last"][n] for n in names], np.int64)
        carry = carry + own if open_group == e["last"][group] else own
        open_group = e["last"][group]
    offsets = spark.sparkContext.broadcast(handed)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)[:-2]
            if batch.num_rows and offsets.value:
                parts, groups = (batch.column(k).to_numpy(zero_copy_only=False) for k in (len(columns), group_at))
                for part in np.unique(parts):
                    if int(part) in offsets.value:
                        first, more = offsets.value[int(part)]
                        hit = (parts == part) & (groups == first)
                        for k, c in enumerate(at):
                            columns[c] = pa.array(columns[c].to_numpy(zero_copy_only=False) + np.where(hit, more[k], 0))
            yield pa.RecordBatch.from_arrays(columns, all_names)

    return table.mapInArrow(added, valued_out.schema)


def beginnings(first: str, second: str) -> list[Column]:
    """Two short columns that never fall where (first, second) rises: the second says nothing where the first is cut."""
    cut = F.substring(second, 1, BEGINNING)
    return [F.substring(first, 1, BEGINNING), F.when(F.char_length(first) < BEGINNING, cut).otherwise("")]


def heads(conv: Column) -> Column:
    """How many first turns a conversation takes from the first of its group."""
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("int")


def ordered_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, digest, words, own): turns numbered from 1 in their conversation. A turn is known by the digest of its role and text from here on."""
    said = F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text")
    plain = df.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    plain = plain.withColumn("digest", F.sha2(said, 256))
    keyed = written(plain.select("conv", "turn", "digest", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row")), "turns")
    # turns of one number stand by role and text; only those are sorted by them
    ties = written(keyed.groupBy("conv", "turn").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select(F.col("conv").alias("c"), F.col("turn").alias("t")), "ties")
    numbered = keyed.withColumn("rank", F.lit(0).cast("long"))
    if not ties.isEmpty():
        same = (F.col("conv") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
        pair, pairs = F.struct("conv", "turn"), ties.select(F.struct(F.col("c").alias("conv"), F.col("t").alias("turn")).alias("pair"))
        tied = written(attach(plain.withColumn("pair", pair), pairs, "pair", "left_semi").groupBy("conv", "turn", "role", "text").agg(F.min("digest").alias("digest")), "tied")
        first = F.col("turn").asc_nulls_first()
        ranks = running(tied, "conv", [first, F.col("role").asc(), F.col("text").asc()], {"rank": F.lit(1)}, "ranks", [first, *beginnings("role", "text")], ["role", "text"])
        ranks = ranks.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("digest").alias("d"), "rank")
        numbered = keyed.join(F.broadcast(ranks) if is_small(ranks) else unsent(ranks), same & (F.col("digest") == F.col("d")), "left").select(*keyed.columns, F.coalesce("rank", F.lit(0).cast("long")).alias("rank"))
    order = [F.col("turn").asc_nulls_first(), F.col("rank").asc(), F.col("row").asc()]
    return running(numbered, "conv", order, {"own": F.lit(1)}, "numbered").select("conv", "digest", "words", "own")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, digest, words, depth) of the rebuilt conversations, and (conv, n) of all of them, those without a turn too."""
    convs = written(turns.where("own = 1").select("conv", heads(F.col("conv")).alias("h"), (F.col("conv") - F.col("conv") % GROUP).alias("base")), "convs")
    first = turns.where((F.col("own") < HEADS) & (F.col("conv") % GROUP == 0)).select(F.col("conv").alias("b"), "digest", "words", F.col("own").alias("depth"))
    head = convs.join(unsent(written(first, "heads")), (F.col("base") == F.col("b")) & (F.col("depth") <= F.col("h"))).select("conv", "digest", "words", "depth")
    head = written(head, "heads")
    taken = convs.join(unsent(head.groupBy("conv").agg(F.count("*").alias("taken")).withColumnRenamed("conv", "c")), F.col("conv") == F.col("c"), "left")
    taken = written(taken.select("conv", "h", F.coalesce("taken", F.lit(0)).alias("taken")), "taken")
    own = attach(turns, taken, "conv").where("own > h").select("conv", "digest", "words", (F.col("own") - F.col("h") + F.col("taken")).alias("depth"))
    return head.unionByName(own), convs.select("conv")


def lanes(depth: str, digest: str) -> list[Column]:
    """Two numbers of 60 bits from a turn and its place."""
    hex_ = F.sha2(F.concat_ws(":", F.col(depth).cast("string"), digest), 256)
    return [F.conv(F.substring(hex_, 1 + 15 * k, 15), 16, 10).cast("long") for k in range(2)]


def cells(a: np.ndarray, b: np.ndarray, bits: int, row: int) -> np.ndarray:
    """Where a digest is counted in a row of the sketch."""
    mixed = (a + np.uint64(row) * b) * np.uint64(0x9E3779B97F4A7C15)  # a fixed odd number: 2^64 over the golden ratio
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def sketched(prefixes: DataFrame, bits: int) -> np.ndarray:
    """The count-min sketch of all (a, b): counters that stop at 2, as no more is asked of them.

    A task has a sketch of its own; blocks of sketches are added up by Spark, and the driver puts SKETCH_ROWS << bits bytes together.
    """
    size, block = 1 << bits, 1 << min(bits, 16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((SKETCH_ROWS, size), np.uint8)
        for batch in batches:
            a, b = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.uint64) for k in (0, 1))
            for row in range(SKETCH_ROWS):
                at, n = np.unique(cells(a, b, bits, row), return_counts=True)
                own[row, at] = np.minimum(2, own[row, at] + np.minimum(n, 2))
        for k, part in enumerate(own.reshape(-1, block)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "part": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

    def add(keys: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(block, np.uint8)
        for pdf in batches:
            for p in pdf["part"]:
                total = np.minimum(2, total + np.frombuffer(zlib.decompress(p), np.uint8))
        yield pd.DataFrame({"k": [keys[0]], "part": [zlib.compress(total.tobytes(), 1)]})

    parts = prefixes.select("a", "b").mapInArrow(count, "k int, part binary")
    out = np.zeros((SKETCH_ROWS * size // block, block), np.uint8)
    for r in parts.groupBy("k").applyInPandas(add, "k int, part binary").toLocalIterator():
        out[r["k"]] = np.frombuffer(zlib.decompress(bytes(r["part"])), np.uint8)
    return out.reshape(SKETCH_ROWS, size)


def screened(prefixes: DataFrame) -> DataFrame:
    """prefixes with maybe: false where the sketch proves that one conversation alone has the prefix."""
    spark, n = prefixes.sparkSession, prefixes.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (PER_PREFIX * n).bit_length()))
    sketch = spark.sparkContext.broadcast(sketched(prefixes, bits))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.uint64) for k in (names.index("a"), names.index("b")))
            estimate = np.min([sketch.value[row, cells(a, b, bits, row)] for row in range(SKETCH_ROWS)], axis=0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(estimate > 1)], [*names, "maybe"])

    names = prefixes.columns
    kinds = ", ".join(f"{c} {t}" for c, t in prefixes.dtypes)
    return prefixes.mapInArrow(look, f"{kinds}, maybe boolean")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the SHA-256 of a node's member ids, ascending, comma-joined. ends: node, conv.

    Ids are sorted by ranges of node and number; each range makes texts of up to CHUNK characters of them, and one stream of
    a node's texts, in order, is hashed, so a task never holds a node's members.
    """
    small_batches(ends.sparkSession)

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, node, ids, size = TaskContext.get().partitionId(), 0, None, [], 0

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"node": [node], "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int64()), "ids": [",".join(ids)]})

        for batch in batches:
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (n != node or size > CHUNK):
                    yield chunk()
                    number, ids, size = number + 1, [], 0
                node = n
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield chunk()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, hashlib.sha256()
        for batch in batches:
            out: list[tuple[str, str]] = []
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n != node:
                    if node is not None:
                        out.append((node, digest.hexdigest()))
                    node, digest = n, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.string()), pa.array([digest.hexdigest()], pa.string())], ["node", "ends_sha256"])

    chunks = ends.select("node", "conv").repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(join_up, "node string, part int, number long, ids string")
    return chunks.repartition("node").sortWithinPartitions("node", "part", "number").select("node", "ids").mapInArrow(hashed, "node string, ends_sha256 string")


def trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The nodes of the trie of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = written(ordered_turns(df, conv, turn, role, text), "turns")
    rows, convs = rebuilt(turns)
    a, b = lanes("depth", "digest")
    placed = rows.select("conv", F.col("depth").cast("long").alias("depth"), "words", a.alias("la"), b.alias("lb"))
    prefixes = running(placed.select("conv", "depth", "words", "la", "lb"), "conv", [F.col("depth").asc()], {"a": F.col("la"), "b": F.col("lb")}, "prefixes").drop("la", "lb")
    node = F.concat_ws(".", F.col("depth").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"))
    prefixes = written(prefixes.withColumn("node", node), "prefixes")
    lengths = written(prefixes.groupBy("conv").agg(F.max("depth").alias("n")), "lengths")
    told = written(screened(prefixes).drop("a", "b"), "screened")
    # a prefix of a proven singleton's kind ends what may be shared: estimates can only be too large, so the first proof counts
    proofs = told.where("not maybe").groupBy("conv").agg(F.min("depth").alias("alone"))
    tails_from = written(lengths.join(unsent(proofs.withColumnRenamed("conv", "c")), F.col("conv") == F.col("c"), "left").select("conv", "n", "alone"), "tails")

    # rows that may be shared, and the root of each conversation
    both = attach(told, tails_from, "conv").select("conv", "depth", "words", "node", "n", "alone")
    both = written(both, "told")
    roots = convs.join(unsent(tails_from.withColumnRenamed("conv", "c")), F.col("conv") == F.col("c"), "left").select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), F.lit("0").alias("node"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), "alone")
    maybe = written(both.where("alone is null or depth < alone").unionByName(roots), "maybe")
    groups = written(maybe.groupBy("node").agg(F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("n").alias("longest")), "groups")

    # what stands at the row of the conversation that stands for a node; tails stand for themselves
    stands = groups.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("longest") == F.col("depth")).alias("childless"))
    here = maybe.join(unsent(stands), (F.col("conv") == F.col("c")) & (F.col("depth") == F.col("d")), "left").select("conv", "depth", "node", "n", "alone", F.col("c").isNotNull().alias("stands"), F.coalesce("saved", F.lit(0).cast("long")).alias("saved"), F.coalesce("childless", F.lit(False)).alias("childless"))
    here = written(here, "stands")
    # from the end of the conversation to the row: what is saved; and whether the next row stands
    below = running(here, "conv", [F.col("depth").desc()], {"below": F.col("saved")}, "below")
    # a conversation stands for its leaf if it has a tail, or stands at its last row and nothing goes on there
    leaf = written(here.where((F.col("depth") == F.col("n")) & F.col("stands") & F.col("childless")).select("conv").unionByName(tails_from.where("alone is not null").select("conv")), "leaves")
    leaves = leaf.select("conv", F.lit(1).cast("long").alias("leaf"))
    above = here.where("depth > 0 and stands").select("conv", (F.col("depth") - 1).alias("depth")).unionByName(tails_from.where("alone is not null").select("conv", (F.col("alone") - 1).alias("depth")))
    child = above.select(F.col("conv").alias("c"), F.col("depth").alias("d"), F.lit(1).cast("long").alias("child"))
    marked = below.join(unsent(child), (F.col("conv") == F.col("c")) & (F.col("depth") == F.col("d")), "left").drop("c", "d")
    marked = attach_left(marked, leaves, "conv")
    sums = marked.groupBy("node").agg(F.sum("below").alias("saved_tokens"), F.sum(F.coalesce("child", F.lit(0).cast("long"))).alias("n_children"), F.sum(F.coalesce("leaf", F.lit(0).cast("long"))).alias("n_leaves"))
    sums = written(sums, "sums")
    ends = written(ends_digests(maybe.where("depth = n")), "ends")
    shared = groups.select("node", "conv_id", "depth", "n_convs").join(unsent(sums.withColumnRenamed("node", "s")), F.col("node") == F.col("s"))
    shared = shared.join(unsent(ends.withColumnRenamed("node", "e")), F.col("node") == F.col("e"), "left").select("node", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256"))

    # the parent of a node that is not a tail's: the node of the row before in the standing conversation
    of_parent = here.select(F.col("conv").alias("c"), (F.col("depth") + 1).alias("d"), F.col("node").alias("parent"))
    linked = shared.join(unsent(of_parent), (F.col("conv_id") == F.col("c")) & (F.col("depth") == F.col("d")), "left").drop("c", "d", "node")
    last = here.where(F.col("alone").isNotNull() & (F.col("depth") == F.col("alone") - 1)).select("conv", F.col("node").alias("parent"), "n", "alone")
    names = groups.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    linked = attach_left(written(linked, "linked"), names, "parent").drop("parent")
    tops = attach_left(written(last, "last"), names, "parent").select("conv", F.col("parent_conv_id").alias("top"))
    tops = written(tops, "tops")
    tail = attach(both.where("alone is not null and depth >= alone").select("conv", "depth", "n", "alone"), tops, "conv")
    one = F.lit(1).cast("long")
    is_end = F.col("depth") == F.col("n")
    tails = tail.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("alone"), F.col("top")).otherwise(F.col("conv")).alias("parent_conv_id"), one.alias("n_convs"),
        F.when(is_end, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(is_end, F.sha2(F.col("conv").cast("string"), 256)).otherwise(NO_MEMBERS).alias("ends_sha256"),
    )
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return linked.select(*columns).unionByName(tails.select(*columns))


def attach_left(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return attach(left, right, on, "left")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as own from conversations where conv_id is not null),
k as (select distinct conv_id, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint) as codes from t),
c as (select conv_id, xor(4294967295, list_reduce(codes, lambda a, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, xor(a, b)), 4294967295::bigint)) % 4 as h from k),
f as (select c.conv_id, own as depth, role, text from c join t on t.conv_id = c.conv_id - c.conv_id % 20 and own <= h),
n as (select conv_id, h, (select count(*) from f where f.conv_id = c.conv_id) as heads from c),
r as (select * from f union all select t.conv_id, own - h + heads, role, text from t join n using (conv_id) where own > h),
l as (select c.conv_id, (select count(*) from r where r.conv_id = c.conv_id) as turns from c),
p as (select conv_id, turns, depth, string_agg(md5(strlen(role) || ':' || role || text), '') over (partition by conv_id order by depth) as pre, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from r join l using (conv_id)
  union all select conv_id, turns, 0, '', 0 from l),
g as (select depth, pre, min(conv_id) as rep, count(*) as n_convs, max(turns) as longest, max(words) as words from p group by depth, pre),
j as (select p.conv_id, p.turns, p.depth, p.pre, rep, n_convs, sum(case when rep = conv_id then (n_convs - 1) * g.words else 0 end) over (partition by conv_id order by p.depth desc) as below,
  lead(rep = conv_id) over (partition by conv_id order by p.depth) as child, lag(rep) over (partition by conv_id order by p.depth) as above, max(case when p.depth = turns and rep = conv_id and longest = p.depth then 1 else 0 end) over (partition by conv_id) as leaf from p join g on p.depth = g.depth and p.pre = g.pre)
select rep as conv_id, depth, max(case when rep = conv_id then above end) as parent_conv_id, max(n_convs) as n_convs, sum(case when child then 1 else 0 end)::bigint as n_children, sum(leaf)::bigint as n_leaves, sum(below)::bigint as saved_tokens,
  sha256(coalesce(string_agg(case when depth = turns then conv_id::varchar end, ',' order by j.conv_id), '')) as ends_sha256 from j group by rep, depth, pre
"""
