"""op2: what its columns say of repeated passages, and anchors with more contexts than one task should hold."""

import random
import re
from collections import Counter

from viewframe.llm import substring_dedup
from viewframe.llm.substring_dedup import HOT, REACH, SHARD, SIZE


def letters(rng, n):
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))


def words(rng, n, size):
    return " ".join(letters(rng, size) for _ in range(n))


def rows_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.id: r for r in substring_dedup.without_repeats(docs).collect()}


def test_passages_across_documents_are_told_by_what_is_removed(spark):
    rng = random.Random(11)
    long, short = words(rng, 60, 9), words(rng, 60, 4)  # 599 and 299 bytes
    clean = [words(rng, 150, 7) for _ in range(8)]
    texts = clean + [f"{x} {long} {words(rng, 30, 7)}" for x in clean[:1]] + [f"{words(rng, 40, 7)} {passage} {words(rng, 40, 7)}" for passage in (long, short) for _ in range(4)]
    rows = rows_of(spark, texts)
    assert all(rows[k].n_bytes == len(t.encode()) for k, t in enumerate(texts))  # the whole text, whatever is removed
    assert all(rows[k].n_removed == 0 for k in range(1, 8))
    assert rows[0].n_removed == len(clean[0]) and rows[8].n_removed >= len(clean[0]) + len(long)
    assert all(rows[k].n_removed >= len(long) and long.encode() not in bytes(rows[k].kept) for k in range(9, 13))
    assert all(rows[k].n_removed == 0 for k in range(13, 17))  # over 50 words, but no string of 400 bytes


def test_an_anchor_with_more_contexts_than_a_shard_is_dealt_over_tasks(spark, monkeypatch):
    assert HOT * (SIZE + REACH) <= SHARD
    rng = random.Random(12)
    lowest = lambda x: next(substring_dedup.text_anchors([("-" * 25 + x + "-" * 25).encode()]))[1].min()
    common = min((letters(rng, 350) for _ in range(50)), key=lowest)  # its anchor is that of almost every text
    texts = [letters(rng, 180) + common + letters(rng, 180) for _ in range(HOT + 100)]
    texts += [letters(rng, 180) + x[175:535] + letters(rng, 180) for x in texts[:20]]  # 360 bytes are alike: nothing repeats
    texts += [letters(rng, 180) + x[130:580] + letters(rng, 180) for x in texts[30:50]]
    texts += texts[:10]
    made, plain = [], substring_dedup.written
    monkeypatch.setattr(substring_dedup, "written", lambda df, what: made.append(what) or plain(df, what))
    rows = rows_of(spark, texts)
    assert "strings" in made
    data = [t.encode() for t in texts]
    many = Counter(b[i : i + SIZE] for b in data for i in range(len(b) - SIZE + 1))
    for k, b in enumerate(data):
        gone = bytearray(len(b))
        for i in range(len(b) - SIZE + 1):
            if many[b[i : i + SIZE]] > 1:
                gone[i : i + SIZE] = b"\1" * SIZE
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (rows[k].n_bytes, rows[k].n_removed, rows[k].n_spans, bytes(rows[k].kept)) == (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept), k
    assert sum(r.n_removed > 0 for r in rows.values()) == 60
