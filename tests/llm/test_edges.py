"""Ids of other types, clashing names, empty tables, repeated rows, salted joins and buckets that are compared by pivots."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from viewframe.llm import exact_dedup, html_extract, mixing, pii, quality, simhash, substring_dedup, token_queries
from viewframe.llm.common import attach

COLUMNS = "doc_id {0}, text string, lang string, source string, n_chars long, __fp string, __digest int, __id int, __size int, digest string"
LONG = " ".join(f"word{k} and more of it" for k in range(3000))


def rows(kind):
    name = (lambda k: f"d{k:03}") if kind == "string" else int
    texts = [None, "", " \n", "one two three", LONG, LONG, LONG + " tail", "Some words that make a plain sentence of ten or more.", "Some  words that make a plain\nsentence of ten or more."]
    out = [(name(k), t, "en", None if k % 3 == 0 else f"s{k % 2}", 0, "x", 1, 2, 3, "y") for k, t in enumerate(texts)]
    return [*out, out[4], (None, LONG, None, None, None, None, None, None, None, None), out[7]]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_stages_on_awkward_rows(spark, kind):
    df = spark.createDataFrame(rows(kind), COLUMNS.format(kind)).repartition(3)
    name = (lambda k: f"d{k:03}") if kind == "string" else int
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    first = exact_dedup.keep_first(df)
    assert first.columns == df.columns and ids(first) == [name(k) for k in (0, 2, 3, 4, 6, 7)]  # null is the empty text
    near = simhash.keep_one(df)
    assert near.columns == df.columns and ids(near) == sorted([name(k) for k in (0, 3, 4, 7)], key=str)
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns and set(ids(mixed)) <= set(ids(df))
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and set(ids(kept)) <= set(ids(df)) and name(7) in ids(kept)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_on_nothing(spark, stage):
    df = spark.createDataFrame([], COLUMNS.format("long"))
    out = stage(spark, df, None)
    assert out.count() == 0 and (stage is corpus_pipeline.STAGES[-1][1] or out.columns == df.columns)


def test_equal_ids_with_different_texts(spark):
    pages = spark.createDataFrame([(1, "https://a.example/", "<p>one</p>"), (1, "https://a.example/", "<p>two</p>"), (None, None, None)], "page_id long, url string, html string")
    assert sorted(r.text for r in html_extract.main_texts(pages).collect()) == ["", "one", "two"]
    docs = spark.createDataFrame([(1, "a b"), (1, "a b c d"), (1, "a b")], "doc_id long, text string")
    path = token_queries.public(token_queries.CODE_VOCABULARY)
    assert sorted(r.n_tokens for r in token_queries.code_digests(docs, path).collect()) == [2, 2, 4]
    assert sorted(r.n_bytes for r in substring_dedup.without_repeats(docs).collect()) == [3, 3, 7]
    assert pii.labelled(docs).count() == 3


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_joins_are_joins(spark, how):
    left = spark.createDataFrame([(k, None if k % 3 == 0 else k % 5, "s") for k in range(200)], "i int, k int, __salt string")
    right = spark.createDataFrame([(None, "n"), (1, "a"), (2, "b"), (9, "z")], "k int, v string")
    few, many = attach(left, right, "k", how), attach(left, right, "k", how, rows=0)
    assert few.columns == many.columns and sorted(map(tuple, few.collect()), key=repr) == sorted(map(tuple, many.collect()), key=repr)
    assert "__salt" in many.columns


@pytest.mark.parametrize("hot", [simhash.HOT, 40])
def test_links_of_a_crowded_bucket(spark, hot):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 64, 3, dtype=np.uint64)
    fps = {int(b) ^ sum(1 << int(x) for x in rng.integers(0, 20, rng.integers(0, 7))) for b in base for _ in range(120)}
    fps = sorted(fps)
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= simhash.LINK:
                up[root(a)] = root(b)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(3)
    linked = {f: f for f in fps}

    def top(f):
        while linked[f] != f:
            f = linked[f]
        return f

    for r in simhash.links(df, hot).collect():
        a, b = r.a % (1 << 64), r.b % (1 << 64)
        assert (a ^ b).bit_count() <= simhash.LINK
        linked[top(a)] = top(b)
    assert len({root(f) for f in fps}) == len({top(f) for f in fps})
    assert all((root(a) == root(b)) == (top(a) == top(b)) for a, b in zip(fps, random.Random(1).sample(fps, len(fps)), strict=True))


def test_hits_are_compared_with_content_of_earlier_loads(spark):
    store = exact_dedup.DedupStore(spark, digest=lambda c: F.substring(F.md5(c), 1, 1), texts=True)
    texts = [f"text {k}" for k in range(40)]
    store.load(spark.createDataFrame(list(enumerate(texts[:20])), "doc_id long, text string"))
    store.advance()
    store.load(spark.createDataFrame(list(enumerate(texts[20:] + texts[:3], 20)), "doc_id long, text string"))
    store.advance()
    import hashlib

    by = {}
    for t in texts:
        by.setdefault(hashlib.md5(t.encode()).hexdigest()[0], set()).add(t)
    assert {r.digest for r in store.clashes().collect()} == {d for d, ts in by.items() if len(ts) > 1}


def test_repeats_of_a_scan_with_clashing_columns(spark, tmp_path):
    """Names that the operator uses itself, in the table's files."""
    text = "".join(chr(97 + k * k % 23) for k in range(1200))
    docs = spark.createDataFrame([(1, text, "x", 1, 2), (2, "head " + text, "y", 3, 4), (3, None, None, None, None)], "doc_id long, text string, __file string, __place int, row int")
    docs.write.parquet(f"{tmp_path}/docs")
    got = {r.id: (r.n_bytes, r.n_spans) for r in substring_dedup.without_repeats(spark.read.parquet(f"{tmp_path}/docs"), plain_scan=True).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 1200, 2: 1205, 3: 0} and got[2][1] == 1
