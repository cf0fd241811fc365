"""The transducer against both libraries on many random texts, long pretokens, and machines that are begun anew."""

import base64
import json
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer as Library

from viewframe.llm import token_queries, tokens
from viewframe.llm.transducer import Table, Transducer

CHARS = "aAsStTrReEvVlLmMdD'''   \n\n\t\x0b\xa0 .,!?#123é中文字😀́　ñ\x1c\x85"
PARTS = ["the", "ing", " tion", "er", "an", "his", "wh", "ß", "größe", " de", "la", "été", "ción", "  ", "\n\n", "12", "999", "!!", "%%%", "--", "don't", "we'll", "<|endoftext|>", "中文", "漢", "😀"]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS if k % 2 else CHARS) for _ in range(rng.randrange(40))) for k in range(n)]


@pytest.fixture(scope="module")
def encoding():
    with open(P.path(token_queries.CODE_VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codes_of_ten_thousand_texts(encoding):
    machine = token_queries.machine(token_queries.vocabulary(P.path(token_queries.CODE_VOCABULARY)))
    texts = random_texts(10_000, 1)
    assert machine.ids(texts) == [encoding.encode_ordinary(t) for t in texts]


def test_counts_of_ten_thousand_texts():
    path = P.path(token_queries.COUNT_VOCABULARY)
    machine, library = token_queries.machine(token_queries.vocabulary(path)), Library.from_file(path)
    texts = random_texts(10_000, 2)
    assert machine.count_with_special(texts) == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_long_pretokens_and_a_machine_begun_anew(encoding):
    rng = random.Random(3)
    machine = token_queries.machine(token_queries.vocabulary(P.path(token_queries.CODE_VOCABULARY)))
    most, machine.transducer.most = machine.transducer.most, 500
    try:
        long = ["a" * 5000, " " * 3000 + "x", "".join(rng.choice("abcdef") for _ in range(20_000)), "=" * 999 + "ab", "\n" * 400]
        for texts in (long, random_texts(300, 4), [x + y for x, y in zip(long, random_texts(5, 5), strict=True)], long * 4, []):
            assert machine.ids(texts) == [encoding.encode_ordinary(t) for t in texts]
    finally:
        machine.transducer.most = most


def test_arcs_carry_counts(encoding):
    machine = token_queries.machine(token_queries.vocabulary(P.path(token_queries.CODE_VOCABULARY))).transducer
    for word in (" internationalization", " größenordnungen", "x" * 70):
        data, state, n = np.frombuffer(word.encode(), np.uint8), 0, 0
        for b in data.tolist():
            arc = int(machine.arc(np.array([state << 8 | b]))[0])
            state, n = int(machine.next.data[arc]), n + int(machine.emit_n.data[arc])
        assert n + int(machine.rest_n.data[state]) == len(encoding.encode_ordinary(word))


def test_tables():
    rng = np.random.default_rng(6)
    keys = np.unique(rng.integers(0, 1 << 40, 5000))
    rng.shuffle(keys)
    table = Table(4)
    for k in range(0, len(keys), 700):
        table.add(keys[k : k + 700])
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()


def test_a_vocabulary_whose_tokens_do_not_all_stand():
    letters = {bytes((b,)): b for b in range(256)}
    ranks = {**letters, b"bc": 256, b"ab": 257, b"abc": 258, b"abcd": 259, b"cd": 260, b"xyz": 261}  # xyz has no merges, abcd comes of abc and d
    own = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdxyz") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    words = [w for w in dict.fromkeys(words) if w != "xyz"]
    size = np.array([*map(len, words)])
    many, flat = Transducer(ranks).run(np.frombuffer("".join(words).encode(), np.uint8), np.cumsum(size) - size, size)
    end = np.cumsum(many)
    assert [flat[b - n : b].tolist() for b, n in zip(end, many, strict=True)] == [own.encode_ordinary(w) for w in words]


def test_files_that_the_machine_refuses():
    with open(P.path(token_queries.COUNT_VOCABULARY), "rb") as f:
        spec = json.load(f)
    spec["model"]["merges"][:2] = spec["model"]["merges"][1::-1]
    with pytest.raises(ValueError):
        tokens.ranks_of_json(json.dumps(spec).encode())
    spec["model"]["merges"][:2] = spec["model"]["merges"][1::-1]
    spec["added_tokens"][0]["lstrip"] = True
    with pytest.raises(ValueError):
        tokens.ranks_of_json(json.dumps(spec).encode())
