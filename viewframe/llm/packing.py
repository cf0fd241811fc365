"""Operator 11: packing documents into sequences by a grouping genetic algorithm on islands.

Documents become pieces of at most `capacity` tokens, a written table with a row number each. Pieces are
dealt to shards of about SHARD pieces, and each shard is packed on ISLANDS islands. An individual is a
packing, its genes are whole bins: crossover puts well-filled bins of one parent into the other,
drops the bins that hold a document twice then, and puts the displaced documents, largest first, where they
fit best. An epoch runs on every island by itself; then the best packing of an island migrates to the next
one of its shard, by a join of rows. A shard whose best packing has as few bins as its tokens allow is done.
What is loose is packed again: bins with room left are dealt to new shards, whose first individual is the
packing they have, so that a level never needs more bins; at most half of the bins go on, and levels end with one shard.

The search is bounded by EPOCHS and GENERATIONS, whatever the data; every piece is in the result.

Defined results: a null text is the empty text (one piece, the end token alone); repeated rows are packed each by itself;
an empty table gives an empty result; other columns are not read. Reruns over the same files agree.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import random
import re
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewframe.llm.common import released, small_batches, table, written
from viewframe.llm.token_queries import public, slices, vocabulary

CAPACITY, END, VOCABULARY = 4096, 1, "word_bpe_49k.json"
#: Pieces of a shard, islands of a shard, and what an island does.
SHARD, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4096, 3, 3, 12, 4
#: A level packs again what a shard's bins hold that are less than FULL, but the emptier half of its bins at most.
FULL, LEVELS = 0.99, 31
#: Words whose ids a worker keeps, and the longest one that it keeps.
KEPT_WORDS, KEPT_BYTES = 1_000_000, 64
#: Letters that are composed already and have one lower case letter each, in any Unicode version.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Fixed value: the pretokens of the vocabulary's file.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What may follow a word as one more pretoken; apostrophes and the letters of special tokens do not.
MARKS = ".,:;!?#*$%&()"

_ids: dict[str, "WordIds"] = {}


class Remembered(dict):
    """What a function gave for a key. Long keys are not kept."""

    def __init__(self, make: Callable[[Any], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, key: Any) -> bytes:
        out = self.make(key)
        if len(key) <= KEPT_BYTES:
            self[key] = out
        return out


class WordIds:
    """Ids of whole texts, by way of the ids of their words between ASCII white space.

    Neither the library's pretokens nor its normalisation cross such white space, so a text's ids are those of its words in
    order; each word goes through the library once while it is remembered. A word of Latin letters, with marks
    behind it, is two pretokens that the normaliser leaves alone but for case: those go to the library's model at once.
    """

    def __init__(self, file: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(file)
        self.known, self.parts = Remembered(self.of_word), Remembered(self.of_part)
        self.model = self.tokenizer.model
        self.plain = self.is_plain(json.loads(file))
        # the library's letters for bytes: printable ones stand for themselves, the others follow from 256 on
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        self.letters = {b: b if b in shown else next(others) for b in range(256)}

    @staticmethod
    def is_plain(config: dict) -> bool:
        """Whether words can be taken by themselves: case folding, white space dropped, pretokens of letters, digits and the rest."""
        steps = [n["type"] for n in (config.get("normalizer") or {}).get("normalizers", [])]
        split = [p.get("pattern", {}).get("Regex", "") for p in (config.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        return steps == ["NFC", "Replace", "Lowercase"] and split[:1] == [PRETOKENS] and config["pre_tokenizer"]["pretokenizers"][0]["behavior"] == "Removed"

    def of_part(self, text: str) -> bytes:
        """The ids of one normalised pretoken."""
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.letters)
        tokens = self.model.tokenize(text)
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def of_word(self, word: bytes) -> bytes:
        text = word.decode()
        core = text.rstrip(MARKS)
        if len(word) <= KEPT_BYTES and core and LATIN.fullmatch(core):
            return self.parts[core.lower()] + (self.parts[text[len(core) :]] if len(core) < len(text) else b"")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, texts: Sequence[str]) -> Iterator[bytes]:
        """Per text its ids, as little-endian unsigned 32-bit numbers."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        if len(self.parts) > KEPT_WORDS:
            self.parts.clear()
        if not self.plain:
            yield from (np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(list(texts), add_special_tokens=False))
            return
        look_up = self.known.__getitem__
        for text in texts:
            yield b"".join(map(look_up, text.encode().split()))


def word_ids(file: bytes) -> WordIds:
    name = hashlib.sha256(file).hexdigest()
    if name not in _ids:
        _ids.clear()
        _ids[name] = WordIds(file)
    return _ids[name]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32. Whole texts, their end token included."""
    small_batches(docs.sparkSession)
    file = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(file.value)
        for batch in batches:
            for at, texts in slices(batch, 1):
                rows: list[tuple[int, int, int, int, int]] = []
                for k, found in enumerate(ids.of(texts), at):
                    whole = memoryview(found + last)
                    for p, start in enumerate(range(0, len(whole) // 4, capacity)):
                        part = whole[4 * start : 4 * (start + capacity)]
                        rows.append((k, p, start, len(part) // 4, zlib.crc32(part)))
                row, piece, start, length, crc = zip(*rows, strict=True)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(c, t) for c, t in zip((piece, start, length, crc), kinds, strict=True))], names)
        released()

    names = ["id", "piece", "start", "length", "ids_crc32"]
    rest = [T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in names[2:])]
    return docs.select(F.col(id).alias("id"), text).mapInArrow(run, T.StructType([T.StructField("id", docs.schema[id].dataType), *rest]))


# ---- packings of one shard: lists of bins, a bin a tuple of item numbers ------------------------

Packing = list[tuple[int, ...]]


def best_fit(bins: list[list[int]], items: Sequence[int], size: Sequence[int], capacity: int) -> list[list[int]]:
    """Puts items in the order given each into the bin that it leaves least room in, or a new one."""
    room = sorted((capacity - sum(map(size.__getitem__, b)), k) for k, b in enumerate(bins))
    for i in items:
        at = bisect.bisect_left(room, (size[i], -1))
        if at == len(room):
            bins.append([i])
            bisect.insort(room, (capacity - size[i], len(bins) - 1))
        else:
            left, k = room.pop(at)
            bins[k].append(i)
            if left > size[i]:
                bisect.insort(room, (left - size[i], k))
    return bins


def fitness(packing: Packing, size: Sequence[int], capacity: int) -> tuple[int, float]:
    """Few bins first, then fills as uneven as can be: an almost empty bin is soon gone."""
    return -len(packing), sum((sum(map(size.__getitem__, b)) / capacity) ** 2 for b in packing)


def crossover(one: Packing, other: Packing, size: Sequence[int], capacity: int, rng: random.Random) -> Packing:
    """one with some well-filled bins of other: bins that hold their documents too are broken up, what they hold besides is put where it fits best."""
    fills = [sum(map(size.__getitem__, b)) for b in other]
    well = [k for k, f in enumerate(fills) if f >= capacity * 0.98]
    own = {frozenset(b) for b in one}
    new = [k for k in well if frozenset(other[k]) not in own]
    chosen = rng.sample(new, rng.randint(1, max(1, len(new) // 2))) if new else []
    injected = [list(other[k]) for k in chosen]
    held = {i for b in injected for i in b}
    stay, displaced = [], []
    weak = set(sorted(range(len(one)), key=lambda k: sum(map(size.__getitem__, one[k])))[: rng.randint(1, 4)])  # mutation: the emptiest bins go too
    for k, b in enumerate(one):
        if k not in weak and held.isdisjoint(b):
            stay.append(list(b))
        else:
            displaced += [i for i in b if i not in held]
    displaced.sort(key=lambda i: (-size[i], i))
    return list(map(tuple, best_fit(injected + stay, displaced, size, capacity)))


def evolved(population: list[Packing], size: Sequence[int], capacity: int, generations: int, rng: random.Random) -> list[Packing]:
    """The population after some generations, best first; it ends where no packing can have fewer bins."""
    least = -(-sum(size) // capacity)
    rank = lambda p: fitness(p, size, capacity)
    scored = sorted(((rank(p), p) for p in population), key=lambda x: x[0], reverse=True)
    for _ in range(generations):
        if len(scored[0][1]) <= least or len(scored) < 2:
            break
        a, b = rng.sample(range(len(scored)), 2)
        children = [crossover(scored[0][1], scored[max(a, b)][1], size, capacity, rng), crossover(scored[a][1], scored[b][1], size, capacity, rng)]
        pool = {p: s for s, p in ((rank(c), tuple(map(tuple, c))) for c in children)} | {tuple(p): s for s, p in scored}
        scored = sorted(((s, list(p)) for p, s in pool.items()), key=lambda x: x[0], reverse=True)[: len(population)]
    return [p for _, p in scored]


def first_population(size: Sequence[int], capacity: int, seeded: Packing | None, rng: random.Random) -> list[Packing]:
    """The packing that there is, best fit of falling sizes, and best fits of orders near that."""
    falling = sorted(range(len(size)), key=lambda i: (-size[i], i))
    orders = [falling, *(sorted(falling, key=lambda i: -size[i] * rng.uniform(0.8, 1.2)) for _ in range(POPULATION - 1))]
    least = -(-sum(size) // capacity)
    out = [seeded] if seeded else []
    for o in orders:
        out.append(list(map(tuple, best_fit([], o, size, capacity))))
        if len(out[-1]) <= least:
            return [out[-1]]  # nothing to search for
    return out


def coded(packing: Packing, n: int) -> bytes:
    bin_of = np.empty(n, "<i4")
    for k, b in enumerate(packing):
        bin_of[list(b)] = k
    return bin_of.tobytes()


def packing_of(code: bytes) -> Packing:
    bin_of = np.frombuffer(code, "<i4")
    order = np.argsort(bin_of, kind="stable")
    edges = np.flatnonzero(np.diff(bin_of[order])) + 1
    return [tuple(map(int, p)) for p in np.split(order, edges)] if len(order) else []


# ---- islands ------------------------------------------------------------------------------------

STATE = "shard long, island int, rows array<long>, sizes array<long>, population array<binary>, bins int, least int"


def settled(shards: DataFrame, capacity: int, seed: int) -> DataFrame:
    """STATE after the first epoch. shards: shard, rows, sizes, bins (array<long> of present bins, or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in one_by_one(batch):
                size, rng = row["sizes"], random.Random(f"{seed}:{row['shard']}:{row['island']}")
                seeded = None
                if row["bins"]:
                    names = {b: k for k, b in enumerate(dict.fromkeys(row["bins"]))}
                    seeded = packing_of(np.array([names[b] for b in row["bins"]], "<i4").tobytes())
                yield state_batch(row, evolved(first_population(size, capacity, seeded, rng), size, capacity, GENERATIONS, rng), capacity)

    each = shards.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).repartition("shard", "island")
    return each.select("shard", "island", "rows", "sizes", "bins").mapInArrow(run, STATE)


def one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    """A shard is large as Python objects, so only one is made at a time."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def state_batch(row: dict, population: list[Packing], capacity: int) -> pa.RecordBatch:
    out = {"shard": row["shard"], "island": row["island"], "rows": row["rows"], "sizes": row["sizes"], "population": [coded(p, len(row["sizes"])) for p in population], "bins": len(population[0]), "least": -(-sum(row["sizes"]) // capacity)}
    kinds = {"shard": pa.int64(), "island": pa.int32(), "rows": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "population": pa.list_(pa.binary()), "bins": pa.int32(), "least": pa.int32()}
    return pa.RecordBatch.from_pydict({k: pa.array([v], kinds[k]) for k, v in out.items()})


def migrated(state: DataFrame, capacity: int, seed: int) -> DataFrame:
    """STATE after another epoch: each island takes in the best packing of the island before it and goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in one_by_one(batch):
                rng = random.Random(f"{seed}:{row['shard']}:{row['island']}")
                population = [packing_of(p) for p in row["population"]]
                population = [*population[: max(1, POPULATION)], packing_of(row["elite"])]
                yield state_batch(row, evolved(population, row["sizes"], capacity, GENERATIONS, rng), capacity)

    elites = state.select(F.col("shard").alias("s"), ((F.col("island") + 1) % ISLANDS).alias("i"), F.col("population")[0].alias("elite"))
    both = state.join(elites, (F.col("shard") == F.col("s")) & (F.col("island") == F.col("i")))
    return both.select("shard", "island", "rows", "sizes", "population", "elite").mapInArrow(run, STATE)


def packed(rows: DataFrame, count: int, capacity: int, level: int, shard_size: int = SHARD) -> DataFrame:
    """(row, shard, bin, room): a packing of the rows (row, length, and old, a whole number per present bin, or null).

    Rows of one old bin go to one shard, others each by themselves.
    """
    n = max(1, -(-count // shard_size))
    key = F.coalesce("old", "row")
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(level), key), F.lit(n)))
    lists = F.sort_array(F.collect_list(F.struct("row", "length", "old")))  # about shard_size rows
    shards = dealt.groupBy("shard").agg(lists.alias("x")).select("shard", F.col("x.row").alias("rows"), F.col("x.length").alias("sizes"), F.when(F.col("x")[0]["old"].isNotNull(), F.col("x.old")).alias("bins"))
    state = written(settled(shards, capacity, level), "islands")
    done = []
    best = lambda s: s.groupBy("shard").agg(F.min_by(F.struct("rows", "sizes", F.col("population")[0].alias("code"), "bins"), F.struct("bins", "island")).alias("b")).select("shard", "b.*")
    for epoch in range(1, EPOCHS):
        open_ = state.groupBy("shard").agg(F.min("bins").alias("m"), F.min("least").alias("l")).where("m > l").select(F.col("shard").alias("s"))
        if open_.isEmpty():
            break
        done.append(state.join(open_, F.col("shard") == F.col("s"), "left_anti"))
        state = written(migrated(state.join(open_, F.col("shard") == F.col("s"), "left_semi"), capacity, level * 100 + epoch), "islands")
    for d in done:
        state = state.unionByName(d)

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in one_by_one(batch):
                sizes, bins = np.array(row["sizes"], np.int64), np.frombuffer(row["code"], "<i4")
                fill = np.bincount(bins, sizes).astype(np.int64)
                order = np.argsort(bins, kind="stable")
                before = np.cumsum(sizes[order]) - sizes[order]
                offset = np.empty_like(sizes)
                offset[order] = before - np.concatenate([[0], np.cumsum(fill)[:-1]])[bins[order]]
                emptiest = np.argsort(fill, kind="stable")[: -(-len(fill) // 2)]
                loose = np.isin(bins, emptiest[fill[emptiest] < FULL * capacity])
                arrays = [np.array(row["rows"], np.int64), np.full(len(sizes), row["shard"], np.int64), bins.astype(np.int64), offset, sizes]
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.array(loose)], ["row", "shard", "bin", "offset", "length", "loose"])

    return best(state).select("shard", "rows", "sizes", "code").mapInArrow(lay_out, "row long, shard long, bin long, offset long, length long, loose boolean")


def sequences(parts: DataFrame, capacity: int = CAPACITY, shard_size: int = SHARD) -> DataFrame:
    """pieces() with sequence_id and offset."""
    numbered = written(parts.withColumn("row", F.monotonically_increasing_id()), "pieces")
    rows, out = numbered.select("row", "length", F.lit(None).cast("long").alias("old")), None
    for level in range(LEVELS):
        count = rows.count()
        last = count <= shard_size or level == LEVELS - 1
        laid = written(packed(rows, count, capacity, level, shard_size), "packed")
        # numbers of a level's bins: level, shard and bin side by side
        name = F.lit(level << 58).cast("long") + F.shiftleft(F.col("shard"), 20) + F.col("bin")
        laid = laid.withColumn("sequence_id", name)
        stays = laid if last else laid.where("not loose")
        stays = stays.select(F.col("row").alias("r"), "sequence_id", "offset")
        out = stays if out is None else out.unionByName(stays)
        if last:
            break
        rows = laid.where("loose").select("row", "length", F.col("sequence_id").alias("old"))
    placed = out.join(numbered, F.col("r") == F.col("row"))
    return placed.select("id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(pieces(table(spark, sf_dir, "documents"), public(VOCABULARY))).withColumnRenamed("id", "doc_id")
