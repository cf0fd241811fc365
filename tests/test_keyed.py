"""Tables by keyed state against the log folded, with ages by event time."""

import random

from pyspark.sql import types as T

from viewframe.operators import retention as R
from viewframe.sources.scratch import scratch
from viewframe.streaming.tables import MaintainedTable, Measure, change_stream

SCHEMA = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("k", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("ts_ms", T.LongType())])
CHANGES = T.StructType([*SCHEMA.fields, T.StructField("op", T.StringType())])


def test_versions_and_ages(spark):
    rng, offset, folder = random.Random(4), 0, scratch(spark, "k")
    plain = MaintainedTable(spark, f"{folder}/plain", SCHEMA, views={"g": (["k"], {"n": Measure("count"), "last": Measure("max", "offset")})}, keyed=True)
    aged = MaintainedTable(spark, f"{folder}/aged", SCHEMA, policy=R.Policy(max_age_ms=30_000), keyed=True)
    state, rows_of = {}, {}
    for k in range(3):
        rows = []
        for _ in range(15):
            offset += 1
            gone = rng.random() < 0.2
            rows.append((rng.randrange(9), None if gone else rng.choice("ab"), offset, offset * 1000, "delete" if gone else "upsert"))
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(f"{folder}/log")
        for t in (plain, aged):
            t.run(change_stream(spark, f"{folder}/log", CHANGES, files_per_batch=100), f"{t.folder}/checkpoint")
        for r in rows:
            state.pop(r[0], None)
            if r[-1] == "upsert":
                state[r[0]] = r[1:4]
        rows_of[k] = dict(state)
        assert {r[0]: tuple(r[1:]) for r in plain.read("table", plain.version()).collect()} == state
        groups = {}
        for kind, o, _ in state.values():
            groups.setdefault(kind, []).append(o)
        assert {tuple(r) for r in plain.read("g", plain.version()).collect()} == {(g, len(v), max(v)) for g, v in groups.items()}
    left = {r[0]: tuple(r[1:]) for r in aged.read("table", aged.version()).collect()}
    assert left.items() <= state.items()
    # all that the newest time makes due has left once its batch has been followed by another
    now = offset * 1000
    live = {i: x for i, x in state.items() if x[2] + 30_000 > now}
    assert live.items() <= left.items() and all(x[2] + 30_000 > now - 15_000 for x in left.values())
