"""Operator 2: removal of repeated substrings with suffix arrays of shards.

Every string of SIZE bytes chooses an anchor in itself: the leftmost smallest hash of its strings of
KEY bytes. Equal strings choose alike, so both copies of a repeated string hold the same anchor at
the same place, and only anchors that occur twice or more need to be looked at. The strings that
chose an anchor start at consecutive places; its context is what they cover, so each string
lies in the context of one anchor. Equal contexts of an anchor are one for the sort (they are counted
before the shuffle, map-side): their bytes go to the shard of the anchor once, or not at all if the
anchor has no other context. A shard's contexts are sorted as one suffix array; suffixes that share
SIZE bytes with a neighbour start at another place too.

An anchor with more than HOT different contexts would be too much for one task. Its contexts are
compared by counting digests of all their strings of SIZE bytes, in an aggregation that combines
map-side, which is exact as well.

Defined results: a null text counts as empty; texts shorter than SIZE bytes lose nothing; repeated
rows are texts like any others and so remove each other; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from viewframe.llm.common import attach, dropped, small_batches, table, written
from viewframe.llm.suffix_array import permuted_lcp, suffix_array

SIZE, KEY = 400, 100
REACH = SIZE - KEY  # bytes before an anchor that a string which chose it may begin at
PIECE, SHARD = 1 << 20, 1 << 20  # bytes hashed together, bytes sorted together
HOT = SHARD // (SIZE + REACH)  # contexts that fill a shard; a task sorts two shards at most, some 100 bytes of memory a byte
SEGMENT = 1 << 22  # a longer text is looked at in overlapping segments
PLACES = 40  # bits of a row's place in its file

_rng = np.random.default_rng(20_400)
_LETTERS = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of width, from the minima of the ends of aligned blocks."""
    n = len(h) - width + 1
    rows = -(-len(h) // width)
    grid = np.full(rows * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid[: len(h)] = h
    grid = grid.reshape(rows, width)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of texts that lie one after the other in data, at bounds; fewer than 2^24 bytes: their positions
    and hashes, and the first and the last start of the strings that chose them."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < SIZE:
        return none, none.view(np.uint64), none, none
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTERS[data] * up, out=sums[1:])
    h = sums[KEY:] - sums[:-KEY]
    h *= down[: len(h)]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    low = np.uint64(0xFFFFFF)
    least = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), REACH + 1) & low
    ends = np.repeat(bounds[1:], np.diff(bounds))[: len(least)]
    starts = np.flatnonzero(np.arange(len(least)) + SIZE <= ends)  # of strings that lie in one text
    if not len(starts):
        return none, none.view(np.uint64), none, none
    least = least[starts].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    at = least[new]
    return at, h[at], starts[new], starts[np.append(new[1:], len(least)) - 1]


def text_anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """For each text the positions in it and the hashes of its anchors, and their strings' first and last starts."""
    group: list[bytes] = []
    size = 0

    def together(group: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        bounds = np.cumsum([0, *map(len, group)])
        at, h, first, last = anchors(np.frombuffer(b"".join(group), np.uint8), bounds)
        cut = np.searchsorted(at, bounds)
        for k in range(len(group)):
            own, begin = slice(cut[k], cut[k + 1]), bounds[k]
            yield at[own] - begin, h[own], first[own] - begin, last[own] - begin

    for text in texts:
        if group and size + len(text) > PIECE:
            yield from together(group)
            group, size = [], 0
        if len(text) <= SEGMENT:
            group.append(text)
            size += len(text)
            continue
        if group:
            yield from together(group)
            group, size = [], 0
        found = []
        for p in range(0, len(text), SEGMENT):  # each string starts in one segment; an anchor at a seam has its strings in two parts
            part = text[p : p + SEGMENT + SIZE - 1]
            at, h, first, last = anchors(np.frombuffer(part, np.uint8), np.array([0, len(part)]))
            found.append((at + p, h, first + p, last + p))
        yield tuple(map(np.concatenate, zip(*found, strict=True)))
    if group:
        yield from together(group)


def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In: row, text. Out: a row per anchor: fp, d1 and d2 (digest of the context and of where in it the anchor is), row, first, last."""
    for batch in batches:
        rows, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        fps, digests, of_row, firsts, lasts = [], [], [], [], []
        for row, text, (at, h, first, last) in zip(rows, texts, text_anchors([t or b"" for t in texts]), strict=True):
            if not len(at):
                continue
            view = memoryview(text)
            for p, a, b in zip(at.tolist(), first.tolist(), last.tolist(), strict=True):
                digests.append(hashlib.blake2b(view[a : b + SIZE], digest_size=16, salt=(p - a).to_bytes(8, "little")).digest())
            fps.append(h)
            firsts.append(first)
            lasts.append(last)
            of_row.append(np.full(len(at), row, np.int64))
        if not fps:
            continue
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        columns = np.concatenate(fps).view(np.int64), halves[:, 0], halves[:, 1], np.concatenate(of_row), np.concatenate(firsts), np.concatenate(lasts)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], list(ANCHOR))


ANCHOR = ("fp", "d1", "d2", "row", "first", "last")


def cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In: row, text, wanted (fp, first, last, twice, hot). Out: fp, hot, twice, row, from, bytes."""
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        for k, row in enumerate(batch.column(0).to_pylist()):
            text, wanted = texts[k].as_py(), batch.column(2)[k].as_py()
            found = [(w["first"], w["last"] + SIZE, w) for w in wanted]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([w["fp"] for _, _, w in found], pa.int64()), pa.array([w["hot"] for _, _, w in found], pa.bool_()), pa.array([w["twice"] for _, _, w in found], pa.bool_()),
                    pa.array([row] * len(found), pa.int64()), pa.array([a for a, _, _ in found], pa.int64()), pa.array([text[a:b] for a, b, _ in found], pa.binary()),
                ],
                ["fp", "hot", "twice", "row", "from", "bytes"],
            )


def repeated(rows: np.ndarray, begins: np.ndarray, twice: np.ndarray, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of the strings of SIZE bytes in parts, those that start at two places of the corpus or more: their rows and positions.

    Parts may overlap in their texts, and a string met twice at one and the same place is not
    repeated. twice marks parts that occur once more elsewhere.
    """
    lengths = np.array([*map(len, parts)])
    s = np.frombuffer(b"\xff".join(parts) + b"\xfe", np.uint8) + np.uint8(2)  # after the sum 1 and 0; UTF-8 has neither byte
    sa = suffix_array(s)
    shared = permuted_lcp(s, sa)[sa] >= SIZE
    begin = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)])
    part = np.repeat(np.arange(len(parts)), lengths + 1)
    run = np.cumsum(~shared)
    inside = shared | np.append(shared[1:], False)
    sa, run = sa[inside].astype(np.int64), run[inside]
    within = sa - begin[part[sa]] + SIZE <= lengths[part[sa]]  # a string that goes on into the next part is none
    sa, run = sa[within], run[within]
    if not len(sa):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = part[sa]
    at = begins[own] + sa - begin[own]
    new = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    differ = lambda x: np.minimum.reduceat(x, new) != np.maximum.reduceat(x, new)
    yes = differ(rows[own]) | differ(at) | np.maximum.reduceat(twice[own], new)
    keep = np.repeat(yes, np.diff(np.concatenate([new, [len(run)]]))) & ~twice[own]
    return rows[own][keep], at[keep]


def merged(rows: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Intervals (row, a, b) that the strings at these places cover."""
    order = np.lexsort((at, rows))
    rows, at = rows[order], at[order]
    new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (at[1:] > at[:-1] + SIZE)])) if len(at) else np.zeros(0, int)
    last = np.append(new[1:], len(at)) - 1 if len(at) else new
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[new], at[new], at[last] + SIZE)], ["row", "a", "b"])


def sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In: fp, twice, row, from, bytes, those of an fp together. Out: intervals (row, a, b)."""
    held: list[tuple] = []
    size = 0

    def done(held: list[tuple]) -> pa.RecordBatch:
        return merged(*repeated(np.array([x[2] for x in held]), np.array([x[3] for x in held]), np.array([x[1] for x in held]), [x[4] for x in held]))

    for batch in batches:
        for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size > SHARD and x[0] != held[-1][0]:
                yield done(held)
                held, size = [], 0
            held.append(x)
            size += len(x[4])
    if held:
        yield done(held)


def hot_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In: fp, twice, row, from, bytes. Out: h1, h2, row, at, weight for each string of SIZE bytes."""
    for batch in batches:
        for _, twice, row, begin, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            many = len(data) - SIZE + 1
            halves = np.frombuffer(b"".join(hashlib.blake2b(data[k : k + SIZE], digest_size=16).digest() for k in range(many)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (halves[:, 0], halves[:, 1], np.full(many, row), np.arange(begin, begin + many), np.full(many, 2 if twice else 1))], ["h1", "h2", "row", "at", "weight"])


def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In: id, text, intervals. Out: id, the text's size, bytes and runs removed, the bytes kept."""
    for batch in batches:
        ids = batch.column(0)
        for k in range(len(batch)):
            text = batch.column(1)[k].as_buffer()
            spans: list[list[int]] = []
            for x in sorted((x["a"], x["b"]) for x in batch.column(2)[k].as_py() or ()):
                if spans and x[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], x[1])
                else:
                    spans.append([*x])
            view = memoryview(text) if text is not None else memoryview(b"")
            edges = [0, *(e for s in spans for e in s), len(view)]
            kept = b"".join(view[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            yield pa.RecordBatch.from_arrays([ids.slice(k, 1), pa.array([len(view)], pa.int64()), pa.array([len(view) - len(kept)], pa.int64()), pa.array([len(spans)], pa.int64()), pa.array([kept], pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])


def joined(batches: Iterator[pa.RecordBatch], rows: int = 2000, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Small batches as larger ones, bounded in rows and bytes."""
    held: list[pa.RecordBatch] = []
    n = total = 0
    for batch in batches:
        held.append(batch)
        n, total = n + len(batch), total + batch.nbytes
        if n >= rows or total >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n, total = [], 0, 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def intervals(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """texts: row, text, partitioned by row. Rows (row, a, b): what repeated strings cover, perhaps in overlapping parts."""
    long = ", ".join(f"{c} long" for c in ANCHOR)
    found = written(texts.where(F.octet_length("text") >= SIZE).select("row", "text").mapInArrow(find_anchors, long), "anchors")
    # aggregates are tables of their own before they are joined: on top of an aggregation by the same key Spark could not split a hot anchor's rows
    often = written(found.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "often")
    shared = written(found.join(often, "fp"), "shared")
    counts = written(shared.groupBy("fp", "d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct("row", "first", "last")).alias("one")), "contexts")
    again = written(counts.where("n > 1").select("fp", "d1", "d2"), "again")
    whole = shared.join(again, ["fp", "d1", "d2"]).select("row", F.col("first").alias("a"), (F.col("last") + SIZE).alias("b"))
    variants = written(counts.groupBy("fp").agg(F.count("*").alias("variants")).where("variants > 1"), "variants")
    one = counts.join(variants, "fp").select("one.row", F.struct("fp", "one.first", "one.last", (F.col("n") > 1).alias("twice"), (F.col("variants") > hot).alias("hot")).alias("w"))
    wanted = one.groupBy("row").agg(F.collect_list("w").alias("wanted"))  # of one text
    cut = texts.join(wanted, "row").select("row", "text", "wanted").mapInArrow(lambda b: joined(cut_contexts(b)), "fp long, hot boolean, twice boolean, row long, `from` long, bytes binary")
    any_hot = not variants.where(F.col("variants") > hot).isEmpty()
    held = [found, often, shared, counts, again, variants]
    if any_hot:
        cut = written(cut, "cuts")
        held.append(cut)
    shards = cut.where("not hot").drop("hot").repartition("fp").sortWithinPartitions("fp")
    out = written(whole, "intervals").unionByName(written(shards.mapInArrow(sort_shards, "row long, a long, b long"), "intervals"))
    if any_hot:
        strings = written(cut.where("hot").drop("hot").mapInArrow(lambda b: joined(hot_strings(b)), "h1 long, h2 long, row long, at long, weight long"), "strings")
        again = written(strings.groupBy("h1", "h2").agg(F.sum("weight").alias("n")).where("n > 1").select("h1", "h2"), "again")
        twice = strings.select("h1", "h2", "row", "at").join(again, ["h1", "h2"])
        out = out.unionByName(written(twice.select("row", F.col("at").alias("a"), (F.col("at") + SIZE).alias("b")), "intervals"))
        held += [strings, again]
    for table_ in held:
        dropped(table_)
    return out


def file_rows(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(row, id, text) of docs, a plain scan of Parquet files. row: the number of its file and its place in it, which stay the
    same however Spark splits the files in each job."""
    named = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    # a row a file, so one task may number them
    files = written(named.select("file").distinct().withColumn("n", F.row_number().over(Window.orderBy("file")).cast("long")), "files")
    return attach(named, files, "file").select(F.shiftleft("n", PLACES).bitwiseOR(F.col("place")).alias("row"), "id", "text")


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", hot: int = HOT, plain_scan: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept (binary, the bytes that stay).

    Rows are numbered, and read several times. Those of a plain scan of Parquet files are known by
    file and place; anything else is written with its numbers first.
    """
    small_batches(docs.sparkSession)
    if plain_scan:
        numbered = file_rows(docs, id, text)
    else:
        numbered = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")), "numbered")
    covered = intervals(numbered, hot).groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))  # of one text
    schema = f"id {docs.schema[id].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary"
    return numbered.join(covered, "row", "left").select("id", "text", "spans").mapInArrow(lambda b: joined(remove(b)), schema)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"), plain_scan=True)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = """
with b as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
n as (select *, length(h) // 2 as n_bytes from b),
w as (select r, i, md5(substr(h, 2 * i + 1, 800)) as k from n, unnest(range(0, n_bytes - 399)) as u(i) where n_bytes >= 400),
t as (select r, i from w qualify count(*) over (partition by k) > 1),
m as (select r, i, case when i - lag(i) over (partition by r order by i) <= 400 then 0 else 1 end as new from t),
s as (select r, i, sum(new) over (partition by r order by i) as span from m),
v as (select r, span, min(i) as a, max(i) + 400 as z from s group by r, span),
p as (select r, a, z, coalesce(lag(z) over (partition by r order by a), 0) as y from v),
k as (select r, sum(z - a) as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * y + 1, 2 * (a - y)), '' order by a) as head, max(z) as last from p join n using (r) group by r)
select doc_id, n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from n left join k using (r)
"""
