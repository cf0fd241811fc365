"""Maintained groups, window scripts and joined views against what plain Python makes of the same rows."""

import random
from collections import defaultdict
from decimal import Context, Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewframe.operators import changes as C
from viewframe.operators import retention as R
from viewframe.sources.scratch import scratch
from viewframe.streaming.tables import MaintainedJoin, MaintainedTable, Measure

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("row_id", T.LongType()), ("g", T.StringType()), ("d", T.DoubleType()), ("k", T.LongType()), ("m", T.DecimalType(10, 2)), ("s", T.StringType()), ("has_s", T.BooleanType()), ("offset", T.LongType()))])
CHANGES = T.StructType([*SCHEMA.fields, T.StructField("op", T.StringType())])
VIEW = {
    "n": Measure("count"), "labels": Measure("countDistinct", "s", "has_s"), "total": Measure("sum", "d"), "mean": Measure("avg", "d"), "whole": Measure("sum", "k"), "average": Measure("avg", "k"),
    "money": Measure("sum", "m"), "price": Measure("avg", "m"), "low": Measure("min", "d"), "high": Measure("max", "s"), "far": Measure("max", "k"),
}


def of_group(rows):
    some = lambda c: [r[c] for r in rows if r[c] is not None]
    total = sum((Fraction(x) for x in some("d")), Fraction(0))
    even = lambda q, places: Decimal(round(q * 10**places)).scaleb(-places, Context(prec=60)) if q is not None else None
    mean = lambda vs: sum(map(Fraction, vs), Fraction(0)) / len(vs) if vs else None
    labels = {(bool(r["has_s"]) or r["s"] is not None, r["s"]) for r in rows}
    return (
        len(rows), len(labels), float(total), float(total / len(some("d"))) if some("d") else None, Decimal(sum(some("k"))), even(mean(some("k")), 18),
        Decimal(sum(some("m"), Decimal(0))), even(mean(some("m")), 18), min(some("d"), default=None), max(some("s"), default=None), max(some("k"), default=None),
    )


def log(n, size, seed):
    rng, offset, out = random.Random(seed), 0, []
    for _ in range(n):
        rows = []
        for _ in range(size):
            offset += 1
            if rng.random() < 0.25:
                rows.append((rng.randrange(14), None, None, None, None, None, None, offset, "delete"))
            else:
                s = rng.choice([None, None, "", "x", "y", "ÿ"])
                d = rng.choice([None, 1e16, -1e16, 1.0, 0.1, 5e-324, -0.0, 2.5])
                rows.append((rng.randrange(14), rng.choice([None, "a", "b"]), d, rng.choice([None, 0, 7, -7, 2**62]), rng.choice([None, Decimal("0.01"), Decimal("-10.50")]), s, rng.choice([True, False, None]) if s is None else True, offset, "upsert"))
        out.append(rows)
    return out


def test_every_version_is_what_its_rows_say(spark):
    out = MaintainedTable(spark, scratch(spark, "t"), SCHEMA, views={"six": (["g"], VIEW), "all": ([], {"n": Measure("count"), "labels": Measure("countDistinct", "s", "has_s"), "total": Measure("sum", "d")})}, buckets=3)
    state = {}
    for k, rows in enumerate([*log(4, 10, 3), [(i, *[None] * 6, 1000 + i, "delete") for i in range(14)]]):
        out.apply(spark.createDataFrame(rows, CHANGES), k)
        for r in rows:
            state.pop(r[0], None)
            if r[-1] == "upsert":
                state[r[0]] = dict(zip(SCHEMA.names, r[:-1], strict=True))
        groups = defaultdict(list)
        for r in state.values():
            groups[r["g"]].append(r)
        got, expected = {tuple(r) for r in out.read("six", k).collect()}, {(g, *of_group(rs)) for g, rs in groups.items()}
        assert got == expected, repr((got - expected, expected - got))
        whole = of_group(list(state.values()))
        assert [tuple(r) for r in out.read("all", k).collect()] == [whole[:3]]


def test_steps_of_count_distinct(spark):
    """Insert, duplicate, remove one of them, remove the last, insert again, move, to null, two nulls, missing besides null."""
    put = lambda i, g, s, has=True: (i, g, None, None, None, s, has, None, "upsert")
    gone = lambda i: (i, *[None] * 7, "delete")
    steps = [
        ([put(1, "a", "x")], {"a": 1}), ([put(2, "a", "x")], {"a": 1}), ([gone(1)], {"a": 1}), ([gone(2)], {}), ([put(1, "a", "x"), put(2, "a", "y")], {"a": 2}),
        ([put(1, "b", "x")], {"a": 1, "b": 1}), ([put(2, "a", None)], {"a": 1, "b": 1}), ([put(3, "a", None)], {"a": 1, "b": 1}), ([put(2, "a", "z")], {"a": 2, "b": 1}), ([gone(3)], {"a": 1, "b": 1}),
        ([put(4, "a", None, False), put(5, "a", None), put(6, "a", "")], {"a": 4, "b": 1}), ([put(4, "a", None)], {"a": 3, "b": 1}),
    ]
    out, offset = MaintainedTable(spark, scratch(spark, "t"), SCHEMA, views={"d": (["g"], {"n": Measure("countDistinct", "s", "has_s")})}), 0
    for k, (rows, expected) in enumerate(steps):
        numbered = [(*r[:-2], offset + i, r[-1]) for i, r in enumerate(rows)]
        offset += len(rows)
        out.apply(spark.createDataFrame(numbered, CHANGES), k)
        assert dict(map(tuple, out.read("d", k).collect())) == expected


def test_a_batch_reads_the_buckets_it_touches(spark):
    out = MaintainedTable(spark, scratch(spark, "t"), SCHEMA, views={"g": (["g"], {"n": Measure("count"), "low": Measure("min", "k")})}, buckets=16)
    rows = lambda ids, offset: spark.createDataFrame([(i, f"g{i % 9}", 1.0, i, None, None, None, offset + i, "upsert") for i in ids], CHANGES)
    out.apply(rows(range(400), 0), 0)
    out.apply(rows([5], 1000), 1)
    assert len(out.store.rows.touched(1)) == 1
    read = lambda buckets: {f.rpartition("/bucket=")[2].split("/")[0] for f in out.store.state(0, buckets=buckets).inputFiles()}
    assert len(read(None)) == 16
    one = out.store.state(0, buckets=out.store.rows.touched(1))
    seen = {r[0] for r in one.select(F.input_file_name()).distinct().collect()}
    assert len({f.rpartition("bucket=")[2].split("/")[0] for f in seen}) == 1 and one.count() < 80


def test_scripts_rebuild_windows(spark):
    rng = random.Random(8)
    old_rows, new_rows, expected = [], [], {}
    for w in range(30):
        old = rng.sample(range(40), rng.randrange(0, 25))
        new = rng.sample(range(40), rng.randrange(0, 25)) if w % 3 else [99, *old]
        value = {k: rng.random() < 0.3 for k in new}
        old_rows += [(w, k, i, 0) for i, k in enumerate(old)]
        new_rows += [(w, k, i, int(value[k])) for i, k in enumerate(new)]
        working, script = list(old), []
        for k in [k for k in reversed(old) if k not in new]:
            script.append((k, "remove", working.index(k), None))
            working.remove(k)
        for i, k in enumerate(new):
            if k not in working:
                script.append((k, "insert", None, i))
                working.insert(i, k)
                continue
            if (j := working.index(k)) != i:
                script.append((k, "move", j, i))
                working.insert(i, working.pop(j))
            if value[k]:
                script.append((k, "update", None, i))
        assert working == new
        expected[w] = script
    schema = "w int, row_id int, index long, v int"
    old_df, new_df = spark.createDataFrame(old_rows, schema), spark.createDataFrame(new_rows, schema)
    got = defaultdict(list)
    for r in sorted(C.window_diff(old_df, new_df, ["v"], by=["w"]).collect(), key=lambda r: r.seq):
        got[r.w].append((r.row_id, r.change, r.from_index, r.to_index))
    assert dict(got) == {w: s for w, s in expected.items() if s}
    assert all(len(expected[w]) == 1 + sum(c == "update" for _, c, *_ in expected[w]) for w in range(0, 30, 3))  # one in at the top is one step
    for w in (1, 3, 4):
        before, after = (df.where(F.col("w") == w).drop("w") for df in (old_df, new_df))
        script = C.window_diff(before, after, ["v"])
        fresh = after.join(script.where("change in ('insert', 'update')").select("row_id").distinct(), "row_id", "left_semi").drop("index")
        assert sorted(C.reconstructed(before, script, fresh, 1, 1).select("row_id", "v", "index").collect()) == sorted(after.select("row_id", "v", "index").collect())


def test_patches_of_nested_rows(spark):
    schema = "row_id int, a string, p struct<x: int, y: string, __has_y: boolean, q: struct<z: int>>"
    old = spark.createDataFrame([(1, "a", (1, None, True, (5,))), (2, "a", None), (3, "b", (1, "y", True, None)), (4, None, (1, None, False, (1,)))], schema)
    new = spark.createDataFrame([(1, "a", (2, None, False, (5,))), (2, "a", (1, "n", True, (7,))), (3, "b", None), (4, "c", (1, None, True, None))], schema)
    got = {tuple(r) for r in C.field_patches(old, new, ["a", "p.x", "p.y", "p.q.z"]).collect()}
    assert got == {
        (1, "p.x", "set", "2"), (1, "p.y", "remove", None), (2, "p", "object", None), (2, "p.x", "set", "1"), (2, "p.y", "set", "n"), (2, "p.q", "object", None), (2, "p.q.z", "set", "7"),
        (3, "p", "remove", None), (4, "a", "set", "c"), (4, "p.y", "set", None), (4, "p.q", "remove", None),
    }


@pytest.mark.parametrize("how", ["left", "inner"])
def test_groups_over_a_join_whose_rows_expire(spark, how):
    rng = random.Random(5)
    left_kind = T.StructType([T.StructField(n, T.LongType()) for n in ("row_id", "k", "v", "offset", "ts_ms")])
    right_kind = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("offset", T.LongType())])
    left = MaintainedTable(spark, scratch(spark, "l"), left_kind, policy=R.Policy(max_age_ms=12), buckets=3)
    right = MaintainedTable(spark, scratch(spark, "r"), right_kind, buckets=3)
    view = MaintainedJoin(left, right, scratch(spark, "v"), "k", how, views={"g": (["r.name"], {"n": Measure("count"), "ids": Measure("countDistinct", "l.k"), "most": Measure("max", "l.v"), "sum": Measure("sum", "l.v")})})
    offset = 0
    for k in range(5):
        rows = []
        for _ in range(8):
            offset += 1
            rows.append((rng.randrange(15), rng.choice([None, 0, 1, 2, 3]), rng.randrange(9), offset, offset, "delete" if rng.random() < 0.2 else "upsert"))
        left.apply(spark.createDataFrame(rows, T.StructType([*left_kind.fields, T.StructField("op", T.StringType())])), k)
        right.apply(spark.createDataFrame([(i, f"n{rng.randrange(2)}", k * 10 + i, "delete" if rng.random() < 0.3 else "upsert") for i in rng.sample(range(4), 2)], T.StructType([*right_kind.fields, T.StructField("op", T.StringType())])), k)
        n = view.refresh()
        names = {r.row_id: r.name for r in right.read("table", k).collect()}
        groups = defaultdict(list)
        for r in left.read("table", k).collect():
            assert r.ts_ms + 12 > offset - 8
            if how == "left" or r.k in names:
                groups[names.get(r.k)].append(r)
        expected = {(g, len(rs), len({r.k for r in rs}), max(r.v for r in rs), sum(r.v for r in rs)) for g, rs in groups.items()}
        assert {tuple(r) for r in view.read(n, "g").collect()} == expected
