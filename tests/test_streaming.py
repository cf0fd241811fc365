"""Maintained tables against what is computed from the log at once, batch by batch."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewframe.operators import changes as C
from viewframe.operators import order
from viewframe.operators import retention as R
from viewframe.sources.scratch import scratch
from viewframe.streaming import store
from viewframe.streaming.tables import MaintainedJoin, MaintainedTable, Measure

SCHEMA = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("v", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("ts_ms", T.LongType())])
CHANGES = "row_id long, op string, kind string, v long, offset long, ts_ms long, partition int"


def batches(n, size, seed, ids=12):
    rng, offset, out = random.Random(seed), 0, []
    for _ in range(n):
        rows = []
        for _ in range(size):
            offset += 1
            gone = rng.random() < 0.3
            rows.append((rng.randrange(ids), "delete" if gone else "upsert", None if gone else rng.choice("abc"), None if gone or rng.random() < 0.1 else rng.randrange(9), offset, offset, 0))
        out.append(rows)
    return out


def test_each_version_is_the_log_folded(spark, monkeypatch):
    monkeypatch.setattr(store, "KEPT", 3)
    log = batches(6, 8, 3)
    views = {"kinds": (["kind"], {"n": Measure("count"), "total": Measure("sum", "v"), "low": Measure("min", "v"), "high": Measure("max", "v")})}
    top = lambda df: order.numbered(df.select("row_id", "v"), [F.desc("v"), F.asc("row_id")], 0, 4)
    out = MaintainedTable(spark, scratch(spark, "t"), SCHEMA, views=views, windows={"top": top})
    state = {}
    for k, rows in enumerate(log):
        out.apply(spark.createDataFrame(rows, CHANGES), k)
        if k in (2, 5):  # the last time an old version has been let go of by then
            out.apply(spark.createDataFrame(rows, CHANGES), k)  # given again
        before = dict(state)
        for r in rows:
            if r[1] == "delete":
                state.pop(r[0], None)
            else:
                state[r[0]] = (r[2], r[3], r[4], r[5])
        assert {r[0]: tuple(r[1:]) for r in out.read("table", out.version()).collect()} == state
        kinds = {}
        for kind, v, *_ in state.values():
            kinds.setdefault(kind, []).append(v)
        some = lambda f, vs: f([v for v in vs if v is not None], default=None)
        assert {tuple(r) for r in out.read("kinds", k).collect()} == {(kind, len(vs), sum(v or 0 for v in vs), some(min, vs), some(max, vs)) for kind, vs in kinds.items()}
        assert {(r.row_id, r.kind, r.v, r.offset, r.ts_ms, r.weight) for r in out.delta(k).collect()} == {(i, *x, w) for a, b, w in ((before, state, -1), (state, before, 1)) for i, x in a.items() if b.get(i) != x}
        expected = top(out.read("table", k))
        assert {tuple(r) for r in out.received("top", k).select("row_id", "v", "index").collect()} == {tuple(r) for r in expected.collect()}
    assert out.version() == 5


@pytest.mark.parametrize("policy", [R.Policy(max_age_ms=15), R.Policy(max_rows=4), R.Policy(max_age_ms=20, max_rows_per_key=2, cleanup="compact")])
def test_retention_at_each_version(spark, policy):
    out, state, reference = MaintainedTable(spark, scratch(spark, "t"), SCHEMA, policy=policy, key_column="kind"), {}, 0
    log = batches(4, 8, 5)
    log[2], log[3] = log[3], log[2]  # a late batch
    for k, rows in enumerate(log):
        out.apply(spark.createDataFrame(rows, CHANGES), k)
        last = {}
        for r in rows:
            last[r[0]] = r
        reference = max(reference, max((r[5] for r in last.values()), default=0))
        for i, r in last.items():
            state.pop(i, None)
            if r[1] == "upsert":
                state[i] = (r[2], r[3], r[4], r[5])
        if policy.max_age_ms:
            state = {i: x for i, x in state.items() if x[3] + policy.max_age_ms > reference}
        newest = sorted(state, key=lambda i: -state[i][2])
        if policy.max_rows:
            state = {i: state[i] for i in newest[: policy.max_rows]}
        if policy.max_rows_per_key:
            state = {i: state[i] for i in newest if sum(state[j][0] == state[i][0] and state[j][2] > state[i][2] for j in state) < policy.max_rows_per_key}
        assert {r[0]: tuple(r[1:]) for r in out.read("table", k).collect()} == state


def test_source_audit(spark):
    out = MaintainedTable(spark, scratch(spark, "t"), T.StructType([*SCHEMA.fields, T.StructField("partition", T.IntegerType())]), source=("partition", "offset"))
    first, second = batches(2, 6, 9)
    out.apply(spark.createDataFrame(first, CHANGES), 0)
    out.apply(spark.createDataFrame([*first[-3:], *second, second[-1]], CHANGES), 1)
    assert {r.row_id for r in out.read("table", 1).collect()} == {r.row_id for r in C.folded(spark.createDataFrame(first + second, CHANGES)).collect()}
    for bad in ([(*second[0][:2], "other", 99, *second[0][4:])], [(1, "upsert", "a", 1, 5000, 1, 0)]):
        if bad[0][4] == 5000:
            out.apply(spark.createDataFrame(bad, CHANGES), 2)
            bad = first[:1]
        with pytest.raises(ValueError, match="conflict|stale"):
            out.apply(spark.createDataFrame(bad, CHANGES), out.version() + 1)


def test_joined_view(spark):
    users = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("offset", T.LongType())])
    left, right = MaintainedTable(spark, scratch(spark, "l"), SCHEMA), MaintainedTable(spark, scratch(spark, "r"), users)
    view = MaintainedJoin(left, right, scratch(spark, "v"), "v")
    log = batches(4, 8, 11)
    for k, rows in enumerate(log):
        left.apply(spark.createDataFrame(rows, CHANGES), k)
        if k == 0:
            assert view.refresh() is None
        if k < 3:
            right.apply(spark.createDataFrame([(i, "upsert" if (i + k) % 4 else "delete", f"u{i}-{k}" if i % 2 else f"u{i}", k * 10 + i) for i in range(6)], "row_id long, op string, name string, offset long"), k)
        n = view.refresh()
        assert view.refresh() == n
        names = {r.row_id: r.name for r in right.read("table", right.version()).collect()}
        expected = {(r.row_id, r.v, names.get(r.v)) for r in left.read("table", k).collect()}
        assert {(r.row_id, r.l.v, r.r and r.r.name) for r in view.read(n).collect()} == expected
