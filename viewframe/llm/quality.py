"""Operator 7: quality rules as a short-circuit cascade.

Every task estimates each rule's cost and rejection rate on a sample, its first SAMPLE documents,
on which all rules are run and timed; the rest of its documents meet the rules in the order of
rejection per cost and leave at the first that rejects them. The order changes only how
long a document takes: its verdict is that of all rules, whichever comes first.

Defined results: a null text has no words and fails; a row is judged by its text alone, so ties
and repeated rows agree; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from viewframe.llm.common import released, small_batches, table

SAMPLE = 200
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")
BLANKS = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")


class Doc:
    """What the rules look at, each part made when first asked for. bytes.split() takes exactly the
    white space of the contract, [\\x20\\x09-\\x0D]."""

    def __init__(self, text: bytes | None):
        self.text = text or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def n_chars(self) -> int:
        return len(self.text) if self.text.isascii() else len(self.text.decode())

    @cached_property
    def word_chars(self) -> int:
        return self.n_chars - sum(map(self.text.count, BLANKS))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_digits(self) -> int:
        return sum(map(self.text.count, (b"%d" % d for d in range(10))))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeat_words(self.words)


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of width words that are found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    index = dict(zip(seen := dict.fromkeys(words), range(len(seen)), strict=True))
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    key, many = ids[:n], len(index)
    for k in range(1, width):
        if many > 2**62 // len(index):  # renumbered, so that the keys stay exact
            ranks, key = np.unique(key, return_inverse=True)
            many = len(ranks)
        key, many = key * len(index) + ids[k : n + k], many * len(index)
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(key, twice))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_failed(d: Doc) -> bool:
    return d.n_words < MIN_WORDS or 100 * d.n_repeat_words > MAX_REPEAT_PERCENT * d.n_words


#: Name and whether the document is rejected. Counts per word or line, so long texts are not judged by their length. One or two
#: equal lines in a short text are no sign of junk, nor are a few numbers in it.
RULES: dict[str, Callable[[Doc], bool]] = {
    "too_few_words": lambda d: d.n_words < MIN_WORDS,
    "repeats": lambda d: 100 * d.n_repeat_words > MAX_REPEAT_PERCENT * d.n_words,
    "symbols": lambda d: 10 * d.n_symbols > 3 * d.n_words,
    "dup_lines": lambda d: d.n_dup_lines > 2 and 10 * d.n_dup_lines > 3 * len(d.lines),
    "word_length": lambda d: not 2 * d.n_words <= d.word_chars <= 15 * d.n_words,
    "digits": lambda d: 2 * d.n_digits > d.word_chars,
}


class Cascade:
    def __init__(self, rules: dict[str, Callable[[Doc], bool]] = RULES, sample: int = SAMPLE):
        self.rules, self.left = rules, sample
        self.order = list(rules)
        self.cost, self.rejected = dict.fromkeys(rules, 1e-9), dict.fromkeys(rules, 0)

    def keeps(self, text: bytes | None) -> bool:
        if self.left:
            return self.sampled(text)
        d = Doc(text)
        return not any(self.rules[r](d) for r in self.order)

    def sampled(self, text: bytes | None) -> bool:
        """Runs every rule on its own copy of the document, so that each is timed with all that it needs."""
        verdict = True
        for r, rule in self.rules.items():
            began = time.perf_counter()
            no = rule(Doc(text))
            self.cost[r] += time.perf_counter() - began
            self.rejected[r] += no
            verdict &= not no
        self.left -= 1
        self.order = sorted(self.rules, key=lambda r: -self.rejected[r] / self.cost[r])
        return verdict


def texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without those that a rule rejects; all columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade()
        for batch in batches:
            yield batch.filter(pa.array([cascade.keeps(t) for t in texts(batch, text)], pa.bool_()))
        released()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, the counts, base_failed and kept, the cascade's verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade()
        for batch in batches:
            rows = texts(batch, text)
            found = [Doc(t) for t in rows]
            failed = [base_failed(d) for d in found]
            kept = [not no and cascade.keeps(t) for no, t in zip(failed, rows, strict=True)]
            counts = [pa.array([getattr(d, c) for d in found], pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], [id, *COUNTS, "base_failed", "kept"])

    schema = f"`{id}` {docs.schema[id].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean"
    return docs.select(id, text).mapInArrow(run, schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as l from d),
g as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as gram from w, unnest(range(1, len(w) - 3)) as u(i)),
r as (select doc_id, i from g qualify count(*) over (partition by doc_id, gram) > 1),
c as (select doc_id, count(distinct j) as n from r, unnest(range(i, i + 5)) as v(j) group by doc_id),
s as (
  select doc_id, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
         len(l) - len(list_distinct(l)) as n_dup_lines, len(l) as n_lines, length(regexp_replace(t, '[^0-9]', '', 'g')) as n_digits, coalesce(c.n, 0) as n_repeat_words
  from w left join c using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or 10 * n_symbols > 3 * n_words or (n_dup_lines > 2 and 10 * n_dup_lines > 3 * n_lines)
            or word_chars < 2 * n_words or word_chars > 15 * n_words or 2 * n_digits > word_chars) as kept
from s
"""
