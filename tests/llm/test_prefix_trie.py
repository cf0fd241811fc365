"""The prefix trie against one built turn by turn."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewframe.llm import common
from viewframe.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, node string, a int, conv int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    whole = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        whole[c] = convs.get(base, [])[:h] + ts[h:]
    nodes = {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for n in nodes:
        if n:
            children.setdefault(n[:-1], []).append(n)
    leaves, saved, out = {}, {}, set()
    for n in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[n]) - 1) * (len(WORD.findall(n[-1][1])) if n else 0)
        leaves[n] = sum(leaves[k] for k in children.get(n, [])) or 1
        saved[n] = own + sum(saved[k] for k in children.get(n, []))
        ends = hashlib.sha256(",".join(map(str, sorted(c for c in nodes[n] if len(whole[c]) == len(n)))).encode()).hexdigest()
        out.add((min(nodes[n]), len(n), min(nodes[n[:-1]]) if n else None, len(nodes[n]), len(children.get(n, [])), leaves[n], saved[n], ends))
    return out


def conversations(case):
    rng = random.Random(case)
    word = lambda: rng.choice(["a", "b b", "c\td e"])
    rows = [(c, t, rng.choice(["user", "assistant"]), word()) for c in range(70) for t in range(rng.randrange(1, 6))]
    if case == 2:
        hot = [("user", f"turn {t}") for t in range(60)]
        rows += [(c, t, *x) for c in (200, 201, 203, 207, 300, 333) for t, x in enumerate(hot[: 60 - c % 7])]  # long copies
        rows += [(c, 0, "system", "always the same first turn") for c in range(400, 500)] + [(c, 1, "user", f"x{c}") for c in range(400, 500, 2)]
        rows += [(900, None, None, None), (900, None, "z", None), (900, 3, None, "t"), (900, 3, None, "s"), (900, 3, None, "t"), (None, 1, "a", "b"), (-7, 1, "a", "b"), (-20, 1, "q", "r"), (1 << 40, 5, "", "")]
    rng.shuffle(rows)
    return rows


def result(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(3)
    return P.trie(df)


@pytest.mark.parametrize("case", [1, 2])
def test_against_plain_trie(spark, case, monkeypatch):
    rows = conversations(case)
    got = [tuple(r) for r in result(spark, rows).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_a_full_sketch_only_sends_more_the_exact_way(spark, monkeypatch):
    monkeypatch.setattr(P, "LEAST_BITS", 4)
    monkeypatch.setattr(P, "MOST_BITS", 4)
    monkeypatch.setattr(P, "CHUNK", 5)
    rows = conversations(2)
    assert {tuple(r) for r in result(spark, rows).collect()} == brute(rows)


def test_nothing(spark):
    assert result(spark, []).count() == 0
    assert [tuple(r) for r in result(spark, [(1, 0, None, None)]).collect()]


def test_estimates_are_never_too_small(spark):
    rng = np.random.default_rng(1)
    keys = [(int(a), int(b)) for a, b in rng.integers(0, 1 << 60, (300, 2))]
    keys += keys[:100]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(keys)], "k int, a long, b long").repartition(4)
    told = {r.k: r.maybe for r in P.screened(df).collect()}
    twice = {x for x in keys if keys.count(x) > 1}
    assert all(told[k] for k, x in enumerate(keys) if x in twice) and sum(told.values()) < 230


def test_running_sums_over_ranges(spark):
    rng = random.Random(2)
    rows = [(7 if rng.random() < 0.6 else rng.randrange(20), k, rng.randrange(-(1 << 62), 1 << 62)) for k in range(500)]
    df = spark.createDataFrame(rows, "g long, k long, v long").repartition(5)
    got = {(r.g, r.k): r.s for r in P.running(df, "g", [F.col("k").desc()], {"s": F.col("v")}, "t").collect()}
    total = {}
    for g, k, v in sorted(rows, key=lambda r: (r[0], -r[1])):
        total[g] = (total.get(g, 0) + v + (1 << 63)) % (1 << 64) - (1 << 63)
        assert got[g, k] == total[g]


def test_what_was_not_counted_as_small_is_not_broadcast(spark, monkeypatch):
    plans = []

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    def recorded(df, what):
        return common.written(planned(df), what)

    monkeypatch.setattr(common, "is_small", lambda *a: False)
    monkeypatch.setattr(P, "is_small", lambda *a: False, raising=False)
    monkeypatch.setattr(P, "written", recorded)
    rows = conversations(2)
    assert {tuple(r) for r in planned(result(spark, rows)).collect()} == brute(rows)
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not any("Broadcast" in p for p in plans)


def test_long_tied_texts_are_dealt_by_their_beginnings(spark, monkeypatch):
    plans = []

    def recorded(df, what):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.written(df, what)

    monkeypatch.setattr(P, "written", recorded)
    rng = random.Random(3)
    starts, ends = ["", "x" * 127, "x" * 128, "é" * 200, "y" * 300, "\U0001f600" * 128], ["", "a", "b c", "é", "\U0001f600 z"]
    rows = [(c, rng.choice([None, 1]), rng.choice(starts) + rng.choice(ends), rng.choice(starts) + rng.choice(ends)) for c in (0, 1, 20, 23) for _ in range(150)]
    assert {tuple(r) for r in result(spark, rows).collect()} == brute(rows)
    dealt = [x for p in plans for x in re.findall(r"rangepartitioning\((.*)", p)]
    cut = [re.sub(r"(substring|char_length)\((role|text)#\d+[^)]*\)", "", x) for x in dealt]
    assert any("substring(text#" in x for x in dealt) and not any(re.search(r"\b(role|text)#", x) for x in cut)
