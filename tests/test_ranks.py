"""Ranks, windows and anchors of an index kept by changes, against sorted lists."""

import random

from pyspark.sql import types as T

from viewframe.sources.scratch import scratch
from viewframe.streaming import ranks
from viewframe.streaming.tables import MaintainedTable

SCHEMA = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("s", T.StringType()), T.StructField("v", T.DoubleType()), T.StructField("offset", T.LongType())])
CHANGES = T.StructType([*SCHEMA.fields, T.StructField("op", T.StringType())])


def test_against_a_sorted_list(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SLACK", 10)
    rng, state, offset = random.Random(6), {}, 0
    out = MaintainedTable(spark, scratch(spark, "t"), SCHEMA, ranks={"o": [("s", "desc"), ("v", "asc")]})
    index, generations = out.derived.ranks["o"], set()
    for k, size in enumerate((60, 20, 90)):
        rows = []
        for i in rng.sample(range(200), size):
            offset += 1
            gone = rng.random() < 0.15
            rows.append((i, None if gone else rng.choice([None, "a", "b", "c"] if k < 2 else ["zz"]), None if gone else rng.choice([None, 0.1, 1e16, -3.5, 2.0]), offset, "delete" if gone else "upsert"))
        out.apply(spark.createDataFrame(rows, CHANGES), k)
        for r in rows:
            state.pop(r[0], None)
            if r[-1] == "upsert":
                state[r[0]] = r[1:3]
        low = lambda x: (x is not None, x or 0.0)
        ordered = sorted(state, key=lambda i: (low(state[i][1]), i))
        ordered.sort(key=lambda i: (state[i][0] is not None, state[i][0] or ""), reverse=True)
        told = index.told(k)
        generations.add(told["generation"])
        assert index.total(k) == len(ordered)
        for start, n in ((0, 7), (len(ordered) // 2, 9), (len(ordered) - 3, 50), (500, 5)):
            got = sorted((r["index"], r.row_id) for r in index.window(k, start, n).collect())
            assert got == [(i, ordered[i]) for i in range(start, min(len(ordered), start + n))]
        for i in rng.sample(ordered, 3):
            assert index.rank(k, i) == ordered.index(i)
        anchor = rng.choice(ordered)
        at = ordered.index(anchor)
        assert sorted((r["index"], r.row_id) for r in index.around(k, anchor, 4, 4).collect()) == [(i, ordered[i]) for i in range(max(0, at - 4), min(len(ordered), at + 5))]
        assert index.rank(k, 777) is None and index.around(k, 777, 1, 1).count() == 0
        for s in ("b", None):
            first = next((n for n, i in enumerate(ordered) if (state[i][0] or "") <= (s or "") and not (s and state[i][0] is None and False)), len(ordered))
            assert index.place(k, (s,)) == first
    assert len(generations) > 1 and len(told["bounds"]) > 3
