"""Operators 4 and 8 on tables: token counts, and byte-level BPE encoding and decoding.

A vocabulary file is of fixed size; the driver reads it once and Spark broadcasts its bytes.
A Python worker compiles the machine on its first batch and keeps it while it lives, but for the arcs that a task's
texts asked for: Spark keeps workers, and they would hold that memory while other stages run.

Defined results: a null text is the empty text and has no tokens; a row depends on its own text
alone, so repeated rows agree; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from viewframe.llm.common import released, small_batches, table
from viewframe.llm.tokens import StreamDecoder, Tokenizer, ranks_of, ranks_of_json

LIMIT = 512
COUNT_VOCABULARY, CODE_VOCABULARY = "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"
#: Texts of about so many characters are in a worker's hands at a time.
AT_ONCE = 1 << 20

_machines: dict[str, Tokenizer] = {}


def machine(file: bytes) -> Tokenizer:
    """The worker's machine for a vocabulary; only the latest one is kept."""
    name = hashlib.sha256(file).hexdigest()
    if name not in _machines:
        _machines.clear()
        if file.lstrip().startswith(b"{"):
            ranks, special = ranks_of_json(file)
            _machines[name] = Tokenizer(ranks, "tokenizers", special)
        else:
            _machines[name] = Tokenizer(ranks_of(file), "regex")
    return _machines[name]


def rest() -> None:
    """At the end of a task."""
    for tokenizer in _machines.values():
        tokenizer.transducer.forget()
    released()


def slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts), about AT_ONCE characters each."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = size = 0
    for k, n in enumerate([*lengths, None]):
        if n is None or (size and size + n > AT_ONCE):
            if k > begin:
                yield begin, [t or "" for t in batch.column(column).slice(begin, k - begin).to_pylist()]
            begin, size = k, 0
        size += n or 0


def vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit."""
    small_batches(docs.sparkSession)
    file = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokenizer = machine(file.value)
            for at, texts in slices(batch, 1):
                counts = tokenizer.count_with_special(texts)
                size = pa.array([len(t.encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), size, pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], [id, "n_bytes", "n_tokens", "over_limit"])
        rest()

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(run, f"`{id}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def decoded_bytes(tokenizer: Tokenizer, ids: list[int], step: int = 1 << 16) -> bytes:
    """The bytes of ids, by way of the streaming decoder's text where that loses nothing."""
    decoder, parts = StreamDecoder(tokenizer.bytes), []
    for k in range(0, len(ids), step):
        parts.append(decoder.feed(ids[k : k + step]))
    parts.append(decoder.finish())
    return "".join(parts).encode()


def encoded(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id and its token ids."""
    small_batches(docs.sparkSession)
    file = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokenizer = machine(file.value)
            for at, texts in slices(batch, 1):
                many, flat = tokenizer.encoded(texts)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), ids], [id, "ids"])
        rest()

    return docs.select(id, text).mapInArrow(run, f"`{id}` {docs.schema[id].dataType.simpleString()}, ids array<int>")


def decoded(coded: DataFrame, path: str, id: str = "doc_id") -> DataFrame:
    """Per row of encoded()'s result: id and its text."""
    file = coded.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokenizer = machine(file.value)
            texts = [decoded_bytes(tokenizer, ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], [id, "text"])

    return coded.select(id, "ids").mapInArrow(run, f"`{id}` {coded.schema[id].dataType.simpleString()}, text string")


def code_digests(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_tokens, and the digests of its ids and of what they decode to. The ids are not moved."""
    small_batches(docs.sparkSession)
    file = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokenizer = machine(file.value)
            for at, texts in slices(batch, 1):
                counts, of_ids, of_texts = [], [], []
                for ids in tokenizer.ids(texts):
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(",".join(map(tokenizer.decimal.__getitem__, ids)).encode()).hexdigest())
                    of_texts.append(hashlib.sha256(decoded_bytes(tokenizer, ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_texts)], [id, "n_tokens", "ids_sha256", "decoded_sha256"])
        rest()

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(run, f"`{id}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public(COUNT_VOCABULARY))


def op8_bpe_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_digests(table(spark, sf_dir, "documents"), public(CODE_VOCABULARY))
