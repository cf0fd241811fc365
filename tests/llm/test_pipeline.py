"""The pipeline's stages against brute force on the smallest tables."""

import re

import corpus_pipeline
from viewframe.llm import mixing, quality
from viewframe.llm.common import table

from .test_operators import bits, components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, columns = table(spark, SF, "documents"), table(spark, SF, "documents").columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {k: t for k, t in texts.items() if not any(rule(quality.Doc(t and t.encode())) for rule in quality.RULES.values())}
    first = {}
    for k in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[k]), k)
    exact = {k: kept[k] for k in first.values()}
    near = set(components({k: bits(t) for k, t in exact.items()}).values())
    expected = [sorted(kept), sorted(exact), sorted(near)]
    for (_, stage), want in zip(corpus_pipeline.STAGES, expected, strict=False):
        docs = stage(spark, docs, SF)
        assert docs.columns == columns and ids(docs) == want
    copies = {r.doc_id: r["__copies"] for r in mixing.with_copies(docs).collect()}
    mix = corpus_pipeline.STAGES[3][1](spark, docs, SF)
    assert mix.columns == columns and ids(mix) == sorted(k for k, n in copies.items() for _ in range(n))
    last = corpus_pipeline.STAGES[4][1](spark, mix, SF)
    assert ids(last) == ids(mix) and ids(corpus_pipeline.run(spark, SF)) == ids(mix)
