"""Byte-level BPE as finite-state machines, compiled from a vocabulary.

Two machines follow each other. The first splits text into pretokens: a DFA over classes of
characters. Texts are cut into chunks; each chunk is run from all states at once, which gives its
state map; the maps are composed by a parallel prefix scan, and a second run from the now known
states yields the boundaries. The second machine turns the bytes of a pretoken into tokens: a
transducer that is determinised lazily and emits a token as soon as no continuation can change it.
"""

from __future__ import annotations

import base64
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

from viewframe.llm.transducer import Transducer, spans

# ---- pretokens ------------------------------------------------------------------------------

STATES = ("begin", "letters", "digits", "other", "space", "spaces", "blank", "blanks", "quote", "quote_re", "quote_l")
CLASSES = ("letter", "stmd", "rv", "e", "l", "digit", "other", "quote", "space", "blank", "end")
LETTERS = {"letter", "stmd", "rv", "e", "l"}
HERE, BEFORE = 1, 2  # a pretoken starts at this character, at the one before


def fresh(kind: str) -> tuple[str, int]:
    return {"digit": "digits", "other": "other", "quote": "quote", "space": "space", "blank": "blank"}.get(kind, "letters"), HERE


def step(state: str, kind: str) -> tuple[str, int]:
    """The next state, and which pretoken starts this character tells of."""
    if kind == "end":
        return "begin", BEFORE if state in ("quote_re", "quote_l") else 0
    if state in ("letters", "digits", "other"):
        inside = {"letters": LETTERS, "digits": {"digit"}, "other": {"other", "quote"}}[state]
        return (state, 0) if kind in inside else fresh(kind)
    if state in ("space", "spaces", "blank", "blanks") and kind in ("space", "blank"):
        return ("spaces" if kind == "space" else "blanks"), 0
    if state in ("space", "spaces"):  # the last space goes with what follows
        after = "other" if kind == "quote" else fresh(kind)[0]
        return after, 0 if state == "space" else BEFORE
    if state == "blanks":
        after, out = fresh(kind)
        return after, out | BEFORE
    if state == "quote":
        if kind == "stmd":
            return "begin", 0
        if kind in ("rv", "l"):
            return ("quote_re" if kind == "rv" else "quote_l"), 0
        return ("other", 0) if kind in ("other", "quote") else fresh(kind)
    if state in ("quote_re", "quote_l"):
        if kind == {"quote_re": "e", "quote_l": "l"}[state]:
            return "begin", 0
        after, out = ("letters", 0) if kind in LETTERS else fresh(kind)
        return after, out | BEFORE
    return fresh(kind)


def machine() -> tuple[np.ndarray, np.ndarray]:
    """next[state * classes + class], out likewise."""
    both = [step(s, c) for s in STATES for c in CLASSES]
    return np.array([STATES.index(s) for s, _ in both], np.uint8), np.array([o for _, o in both], np.uint8)


END = 0x110000  # stands between texts


def set_kinds(out: np.ndarray, patterns: bool) -> None:
    """Letters, digits and white space by the regex module's tables, or by unicodedata's."""
    if not patterns:
        kinds = {"L": "letter", "N": "digit", "Z": "blank"}
        for c in range(END):
            if kind := kinds.get(unicodedata.category(chr(c))[0]):
                out[c] = CLASSES.index(kind)
        out[[9, 10, 11, 12, 13, 0x85]] = CLASSES.index("blank")
        return
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, END)]))
    shift = lambda i: i if i < 0xD800 else i + 0x800
    for pattern, kind in ((r"\p{L}+", "letter"), (r"\p{N}+", "digit"), (r"\s+", "blank")):
        for m in regex.finditer(pattern, every):
            out[shift(m.start()) : shift(m.end() - 1) + 1] = CLASSES.index(kind)


def library_kind(c: str) -> str:
    """The class that the tokenizers library gives a character, seen from where it cuts."""
    from tokenizers import pre_tokenizers

    cuts = [a for _, (a, _) in pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str(f"!{c}a1{c}")]
    return {(0, 1, 3, 4): "letter", (0, 1, 2, 3): "digit"}.get(tuple(cuts), "other")


@lru_cache(maxsize=2)
def classes(unicode: str) -> np.ndarray:
    """The class of each code point. unicode: whose tables, "regex" (as in tiktoken) or "tokenizers".

    The latter's version of Unicode lies between those of regex and unicodedata, so it is asked
    only about characters on which these two differ.
    """
    out = np.full(END + 1, CLASSES.index("other"), np.uint8)
    set_kinds(out, patterns=True)
    if unicode == "tokenizers":
        older = np.full(END + 1, CLASSES.index("other"), np.uint8)
        set_kinds(older, patterns=False)
        for c in np.flatnonzero(older != out).tolist():
            if not 0xD800 <= c < 0xE000:
                out[c] = CLASSES.index(library_kind(chr(c)))
    for kind, chars in (("stmd", "stmd"), ("rv", "rv"), ("e", "e"), ("l", "l"), ("quote", "'"), ("space", " ")):
        out[[ord(c) for c in chars]] = CLASSES.index(kind)
    out[END] = CLASSES.index("end")
    return out


CHUNK = 256


def composed(maps: np.ndarray) -> np.ndarray:
    """Row k of the result: maps 0 to k, one after the other. A parallel prefix scan in log2(rows) rounds."""
    reach, maps = 1, maps.copy()
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    return maps


ALIKE = 24  # characters after which the runs from all states mostly have come together


def boundaries(kinds: np.ndarray, state: int = 0) -> tuple[np.ndarray, int]:
    """Out bits per character of kinds, from a start state, and the state at the end."""
    after, out = machine()
    width, n = len(CLASSES), len(kinds)
    after = after.astype(np.intp) * width  # states are held as rows of the flat table
    rows = max(1, -(-n // CHUNK))
    grid = np.full(rows * CHUNK, CLASSES.index("end"), np.uint8)  # what is filled up at the end is not looked at
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    every = np.arange(len(STATES), dtype=np.intp) * width
    states = np.tile(every, (rows, 1))
    for k in range(ALIKE):
        states = after[states + grid[k, :, None]]
    apart = np.flatnonzero((states != states[:, :1]).any(axis=1))
    now, rest = states[:, 0], states[apart]
    for k in range(ALIKE, CHUNK):
        now = after[now + grid[k]]
    for k in range(ALIKE, CHUNK):
        rest = after[rest + grid[k, apart, None]]
    maps = np.repeat(now[:, None], len(STATES), axis=1)
    maps[apart] = rest
    scanned = composed(maps // width)
    entry = np.empty(rows, np.intp)
    entry[0] = state
    entry[1:] = scanned[:-1, state]
    bits, now = np.empty((CHUNK, rows), np.uint8), entry * width
    short = n - (rows - 1) * CHUNK  # characters of the last chunk
    for k in range(CHUNK):
        if k == short:
            last = int(now[-1]) // width
        at = now + grid[k]
        bits[k] = out[at]
        now = after[at]
    return np.ascontiguousarray(bits.T).reshape(-1)[:n], last if short < CHUNK else int(now[-1]) // width


PIECE = 1 << 20  # characters that are looked at together


def starts(texts: list[str], unicode: str) -> Iterator[np.ndarray]:
    """For each text the positions at which its pretokens start, the text's length last.

    Texts are taken together until PIECE characters are reached; a longer text is run piece by
    piece, each from the state in which the last one ended, so memory does not grow with it.
    """
    table, group, size = classes(unicode), [], 0

    def flush(group: list[str]) -> Iterator[np.ndarray]:
        stream = np.concatenate([x for t in group for x in (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), [END])]).astype(np.uint32)
        state, found = 0, []
        for p in range(0, len(stream), PIECE):
            bits, state = boundaries(table[stream[p : p + PIECE]], state)
            found.append(np.flatnonzero(bits & HERE) + p)
            found.append(np.flatnonzero(bits & BEFORE) + (p - 1))
        found, at = np.sort(np.concatenate(found)), 0
        for t in group:
            a, b = np.searchsorted(found, (at, at + len(t)))
            yield np.append(found[a:b] - at, len(t))
            at += len(t) + 1

    for t in texts:
        if group and size + len(t) > PIECE:
            yield from flush(group)
            group, size = [], 0
        group.append(t)
        size += len(t) + 1
    if group:
        yield from flush(group)


def cut(text: str, at: np.ndarray) -> list[str]:
    where = at.tolist()
    return [text[a:b] for a, b in zip(where, where[1:], strict=False)]


# ---- vocabularies ---------------------------------------------------------------------------


def ranks_of(file: bytes) -> dict[bytes, int]:
    """A file of ranks: a token in base64 and its number a line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}


def ranks_of_json(file: bytes) -> tuple[dict[bytes, int], list[str]]:
    """A tokenizer file of the byte-level kind: its ranks, and the special strings that it finds in texts.

    The machine takes a token's number for the rank of its merge, so a file whose merges come in another order is refused,
    as are special strings that are found by other rules than their mere presence.
    """
    spec = json.loads(file)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    special = [t["content"] for t in spec["added_tokens"]]
    if any(t.get(rule) for t in spec["added_tokens"] for rule in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("special strings with rules of their own")
    if any(a != b and a in b for a in special for b in special):
        raise ValueError("special strings inside each other")
    vocabulary = spec["model"]["vocab"]
    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)):
        raise ValueError("merges in another order than their tokens")
    return {bytes(back[c] for c in t): k for t, k in vocabulary.items() if t not in special}, special


class Tokenizer:
    """Texts to ids. special: strings that are one token wherever they stand, as the library takes them.

    Each different pretoken of the texts at hand is run through the transducer once, all of them in step.
    """

    def __init__(self, ranks: dict[bytes, int], unicode: str, special: Iterable[str] = ()):
        self.unicode, self.special = unicode, list(special)
        self.transducer = Transducer(ranks)
        self.bytes = {k: t for t, k in ranks.items()}
        self.decimal = {k: str(k) for k in self.bytes}

    def encoded(self, texts: list[str], ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """How many tokens each text has, and the ids of all texts, one after the other."""
        pieces: list[str] = []
        ends = [0]
        for text, at in zip(texts, starts(texts, self.unicode), strict=True):
            pieces += cut(text, at)
            ends.append(len(pieces))
        number = dict.fromkeys(pieces)
        words = [w.encode("utf-8", "surrogatepass") for w in number]
        number.update(zip(number, range(len(number)), strict=True))
        which = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
        del pieces, number
        size = np.array([*map(len, words)], np.int64)
        many, flat = self.transducer.run(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size, ids)
        # at a pretoken's end the machine is back at its start, whatever its state: counts of pretokens just add up, by a prefix sum
        own = many[which]
        total = np.concatenate([[0], np.cumsum(own)])[ends]
        return np.diff(total), flat[spans((np.cumsum(many) - many)[which], own)] if ids else None

    def count(self, texts: list[str]) -> list[int]:
        return self.encoded(texts, ids=False)[0].tolist()

    def ids(self, texts: list[str]) -> list[list[int]]:
        many, flat = self.encoded(texts)
        flat, end = flat.tolist(), np.cumsum(many).tolist()
        return [flat[a:b] for a, b in zip([0, *end], end, strict=False)]

    def count_with_special(self, texts: list[str]) -> list[int]:
        parts, found, whose = [], [0] * len(texts), []
        for k, text in enumerate(texts):
            pieces = [text]
            for s in self.special:
                pieces = [y for x in pieces for y in x.split(s)]
            found[k] = len(pieces) - 1
            parts += pieces
            whose += [k] * len(pieces)
        for k, n in zip(whose, self.count(parts), strict=True):
            found[k] += n
        return found


class StreamDecoder:
    """Ids to text, some at a time. Bytes of a character that is not complete wait for the next call.

    The machine follows UTF-8's lead and continuation bytes; what can't become a character is
    given out as U+FFFD, as the usual lenient decoders do.
    """

    def __init__(self, token_bytes: dict[int, bytes]):
        self.token_bytes, self.waiting = token_bytes, b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end of data begin a character that goes on."""
        for k in range(1, min(3, len(data)) + 1):
            b = data[-k]
            if b < 0x80:
                return 0
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                return k if k < need and b < 0xF5 else 0
        return 0

    def feed(self, ids: Iterable[int]) -> str:
        data = self.waiting + b"".join(map(self.token_bytes.__getitem__, ids))
        keep = self.unfinished(data)
        self.waiting = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        data, self.waiting = self.waiting, b""
        return data.decode("utf-8", "replace")
