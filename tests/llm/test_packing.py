"""Packing: pieces against the tokenizer's library, sequences against what a sequence is, and their number against what must be."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from viewframe.llm import packing as K
from viewframe.llm.token_queries import public

SCHEMA = "doc_id long, text string, row long, id string, length int"


def checked(rows, capacity):
    """Rows of sequences(): each sequence is gapless from 0 and not too long. Gives the number of sequences."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_are_those_of_the_library(spark):
    rng = random.Random(4)
    words = ["don't", "Hello,", "ÀÉ!", "<|endoftext|>", "x<|startoftext|>y", "漢字", "123", "é", "#*$", "ẞ", "İ", "Σ.", "a\x85b", "\x1c", "ﬁ", "q" * 90]
    texts = [None, "", " \n\t", *(" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(40)), "\n".join(rng.choices(words, k=5000)), "y" * 5000]
    docs = spark.createDataFrame([(k, t, 1, "clash", 2) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    library = Tokenizer.from_file(public(K.VOCABULARY))
    expected = set()
    for k, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), 100)):
            part = ids[s : s + 100]
            expected.add((k, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    parts = K.pieces(docs, public(K.VOCABULARY), 100)
    assert {tuple(r) for r in parts.collect()} == expected and parts.count() == len(expected)
    placed = K.sequences(parts, 100, 64).collect()
    assert {tuple(r)[:5] for r in placed} == expected and len(placed) == len(expected)
    checked(placed, 100)


@pytest.mark.parametrize("kind", ["small", "large", "thirds", "equal"])
def test_sequences_are_few(spark, kind):
    rng = random.Random(kind)
    draw = {"small": lambda: rng.randrange(1, 30), "large": lambda: rng.randrange(30, 101), "thirds": lambda: rng.choice([33, 34, 35, 50, 16]), "equal": lambda: 40}[kind]
    sizes = [draw() for _ in range(900)]
    parts = spark.createDataFrame([(7, 0, 0, n, 1) for n in sizes], "id long, piece int, start long, length long, ids_crc32 long").repartition(3)
    rows = K.sequences(parts, 100, 128).collect()
    assert sorted(r.length for r in rows) == sorted(sizes)
    n = checked(rows, 100)
    falling = len(K.best_fit([], sorted(range(900), key=lambda i: -sizes[i]), sizes, 100))
    assert n <= falling * 1.01 + 1
    assert [tuple(r) for r in sorted(K.sequences(parts, 100, 128).collect())] == sorted(map(tuple, rows))


def test_crossover_keeps_every_item_and_gains():
    rng = random.Random(1)
    # triplets that fill bins exactly, which best fit of falling sizes does not find
    size = []
    for _ in range(40):
        a = rng.randrange(26, 49)
        b = rng.randrange(26, 74 - a) if a < 47 else 26
        size += [a, b, 100 - a - b]
    population = K.first_population(size, 100, None, rng)
    first = min(map(len, population))
    out = K.evolved(population, size, 100, 400, rng)
    for p in out:
        assert sorted(i for b in p for i in b) == list(range(len(size))) and all(sum(size[i] for i in b) <= 100 for b in p)
    assert len(out[0]) < first
    assert K.packing_of(K.coded(out[0], len(size))) == [tuple(sorted(b)) for b in out[0]]


def test_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert K.sequences(K.pieces(docs, public(K.VOCABULARY))).count() == 0
