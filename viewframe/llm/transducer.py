"""Byte-level BPE as a lazily determinised finite-state transducer, run over many pretokens in step.

While a pretoken is read byte by byte, the encoding of what has been read can change only where some
token of the vocabulary can still end later. A state is what is not settled: per place, how far the
tokens that begin there have been read (a node of the vocabulary's trie), and the token that ends
there in the encoding of that prefix. A token is settled, and emitted, when all places at which a
token may still begin, and the end, go back through its end; the lookahead is bounded by the longest token.

Two tokens may stand side by side if undoing their merges, latest first, never brings together two
parts that would have been merged before. So the last token of each prefix's encoding is the longest
one that ends there and can stand beside the last token of what precedes it.

States and arcs are made when a text first asks for them, all of a step's new arcs at once. An arc
carries the tokens it emits and their number; at a pretoken's end the state gives the rest and the
machine is back at its start. All of it is arrays of bounded size: beyond MOST_ARCS arcs the machine is begun anew.
"""

from __future__ import annotations

import numpy as np

MOST_ARCS = 250_000
ROWS = 20_000  # arcs made together
FEW = 8  # so few pretokens left in a step are followed one by one
NEVER = 1 << 40
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Numbers of 64-bit keys in the order in which they came: a hash table in two arrays, asked and filled by arrays."""

    def __init__(self, room: int = 1 << 12):
        self.bits = max(room, 2).bit_length()
        self.keys, self.n = np.full(1 << self.bits, -1, np.int64), 0
        self.slot = np.zeros(1 << self.bits, np.int32)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if it is not there."""
        at = self.place(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.slot[at], -1)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        last = len(self.keys) - 1
        while len(open_):
            step = (at[open_] + 1) & last
            at[open_] = step
            held, want = self.keys[step], keys[open_]
            same = held == want
            out[open_[same]] = self.slot[step[same]]
            open_ = open_[~same & (held != -1)]
        return out

    def add(self, keys: np.ndarray) -> None:
        """New keys, all different."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            held = self.keys != -1
            old, slots = self.keys[held], self.slot[held]
            while 2 * (self.n + len(keys)) > 1 << self.bits:
                self.bits += 1
            self.keys, self.slot = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
            self._put(old, slots)
        self._put(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)

    def _put(self, keys: np.ndarray, slots: np.ndarray) -> None:
        at, last = self.place(keys), len(self.keys) - 1
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]  # of several for a place one stays
            won = self.keys[at] == keys
            self.slot[at[won]] = slots[won]
            keys, slots, at = keys[~won], slots[~won], (at[~won] + 1) & last


class Flat:
    """A growing array."""

    def __init__(self, kind=np.int32):
        self.data, self.n = np.zeros(1024, kind), 0

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            grown = np.zeros(max(2 * len(self.data), self.n + len(more)), self.data.dtype)
            grown[: self.n] = self.data[: self.n]
            self.data = grown
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)

    @property
    def all(self) -> np.ndarray:
        return self.data[: self.n]


class Vocabulary:
    """Tokens by rank, the trie of their bytes, the pairs that merge, and the last merge of each token."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = sorted(ranks, key=ranks.__getitem__)
        number = {t: k for k, t in enumerate(tokens)}
        if missing := [b for b in range(256) if bytes((b,)) not in number]:
            raise ValueError(f"{len(missing)} single bytes are no tokens")
        self.size = len(tokens)
        self.ids = np.array([ranks[t] for t in tokens], np.int32)
        self.length = np.array([*map(len, tokens)], np.int32)
        nodes, parents, letters = {b"": 0}, [], []
        for t in tokens:
            k = len(t)
            while t[:k] not in nodes:
                k -= 1
            at = nodes[t[:k]]
            for k in range(k + 1, len(t) + 1):
                parents.append(at)
                letters.append(t[k - 1])
                at = nodes[t[:k]] = len(nodes)
        self.trie = Table(2 * len(nodes))  # the number of an edge is its lower node less one
        self.trie.add(np.array(parents, np.int64) << 8 | np.array(letters, np.int64))
        self.token = np.full(len(nodes), -1, np.int32)  # at a node
        self.token[[nodes[t] for t in tokens]] = np.arange(len(tokens))
        self.goes_on = np.zeros(len(nodes), bool)
        self.goes_on[parents] = True
        pairs, wholes = [], []
        left = right = None
        self.left, self.right = (np.full(self.size, -1, np.int32) for _ in range(2))
        halves: list[tuple[int, int] | None] = [None] * self.size
        for k, t in enumerate(tokens):
            for cut in range(1, len(t)):
                left, right = number.get(t[:cut]), number.get(t[cut:])
                if left is not None and right is not None:
                    pairs.append(left * self.size + right)
                    wholes.append(k)
        self.pairs = Table(2 * len(pairs))
        self.pairs.add(np.array(pairs, np.int64))
        self.whole = np.array(wholes, np.int32)
        self.stands = np.ones(self.size, bool)  # whether a token's bytes are encoded as that token
        for k, t in enumerate(tokens):
            if len(t) == 1:
                continue
            for cut in range(1, len(t)):
                left, right = number.get(t[:cut], k), number.get(t[cut:], k)
                if left < k and right < k and beside(left, right, k, tokens, number, halves):
                    halves[k] = left, right
                    break
            else:
                parts = merged(t, ranks, len(t) - 2)
                self.stands[k] = merged(b"".join(parts), ranks) == [t]
                halves[k] = (number[parts[0]], number[parts[1]]) if len(parts) == 2 else None
            if halves[k]:
                self.left[k], self.right[k] = halves[k]

    def child(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """-1 if there is none."""
        return np.where((edge := self.trie.find(nodes.astype(np.int64) << 8 | letters)) >= 0, edge + 1, -1)

    def beside(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether tokens side by side are what their bytes are encoded as."""
        ok = np.ones(len(left), bool)
        live, left, right = np.arange(len(left)), left.astype(np.int64), right.astype(np.int64)
        before = np.full(len(left), NEVER, np.int64)
        while len(live):
            found = self.pairs.find(left * self.size + right)
            bad = (found >= 0) & (self.whole[found] < before)
            ok[live[bad]] = False
            a, b = (np.where(half[x] >= 0, x, -1) for half, x in ((self.left, left), (self.right, right)))
            on = ~bad & ((a >= 0) | (b >= 0))
            live, left, right, a, b = live[on], left[on], right[on], a[on], b[on]
            first = a > b  # of equal merges the left one is done first, so the right one is undone first
            before = np.where(first, a, b + 1)
            left, right = np.where(first, self.right[left], left), np.where(first, right, self.left[right])
        return ok


def beside(left: int, right: int, before: int, tokens: list[bytes], number: dict[bytes, int], halves: list[tuple[int, int] | None]) -> bool:
    """Whether merges that come before the given one leave two tokens side by side."""
    while True:
        if number.get(tokens[left] + tokens[right], NEVER) < before:
            return False
        a, b = (left if halves[left] else -1), (right if halves[right] else -1)
        if a < 0 and b < 0:
            return True
        if a > b:
            before, left = a, halves[left][1]
        else:
            before, right = b + 1, halves[right][0]


def merged(text: bytes, ranks: dict[bytes, int], most: int = NEVER) -> list[bytes]:
    """The merges done one by one, lowest rank first, most of them at most; for single tokens."""
    parts = [text[i : i + 1] for i in range(len(text))]
    while len(parts) > 1 and (most := most - 1) >= 0:
        rank, at = min((ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == NEVER:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def spans(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers begin[k] to begin[k] + many[k] - 1 of all k, one after the other."""
    total = int(many.sum())
    return np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(total)


class Transducer:
    def __init__(self, ranks: dict[bytes, int], most: int = MOST_ARCS):
        self.vocabulary, self.most = Vocabulary(ranks), most
        self.forget()

    def forget(self) -> None:
        """Begins the machine anew; it may be dropped between any two pretokens."""
        self.arcs = Table()  # keys: state << 8 | byte
        self.next, self.emit_at, self.emit_n = Flat(), Flat(np.int64), Flat()  # by arc
        self.emitted = Flat()  # tokens, as numbers of the vocabulary
        self.numbers: dict[bytes, int] = {}  # of states by what they are
        self.settled, self.size, self.at = Flat(), Flat(), Flat(np.int64)  # by state: the last settled token, its places, where they are held
        self.rest_at, self.rest_n = Flat(np.int64), Flat()  # by state: tokens that are emitted if the input ends
        self.nodes, self.last = Flat(), Flat()  # by place: node of what begins there, token that ends at its other side
        self.followed: dict[int, int] = {}
        self.states(np.array([[-1, 0]], np.int32))

    def states(self, rows: np.ndarray) -> np.ndarray:
        """Numbers of states. rows: settled token, n, and n times node and token."""
        width, data = rows.shape[1] * 4, np.ascontiguousarray(rows).tobytes()
        sizes, out, new = rows[:, 1], [], []
        for k, n in enumerate(sizes.tolist()):
            key = data[k * width : k * width + 8 + 8 * n]
            number = self.numbers.get(key)
            if number is None:
                number = self.numbers[key] = len(self.numbers)
                new.append(k)
            out.append(number)
        if new:
            fresh = rows[new]
            size, many = fresh[:, 1], fresh.shape[1] // 2 - 1
            self.at.extend(self.nodes.n + np.cumsum(size) - size)
            self.settled.extend(fresh[:, 0])
            self.size.extend(size)
            inside = np.arange(many) < size[:, None]
            self.nodes.extend(fresh[:, 2::2][inside])
            last = fresh[:, 3::2]
            self.last.extend(last[inside])
            counts, tokens = self.back(np.concatenate([fresh[:, :1], last], axis=1), size)
            self.rest_at.extend(self.emitted.n + np.cumsum(counts) - counts)
            self.rest_n.extend(counts)
            self.emitted.extend(tokens)
        return np.array(out, np.int32)

    def back(self, last: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens that lead to places, by row: how many each row has, and all of them."""
        rows, at, found = np.arange(len(ends)), ends.astype(np.int64), []
        counts = np.zeros(len(ends), np.int64)
        while True:
            on = at > 0
            rows, at = rows[on], at[on]
            if not len(rows):
                break
            tokens = last[rows, at]
            found.append((rows, tokens))
            counts[rows] += 1
            at = at - self.vocabulary.length[tokens]
        out, left = np.empty(int(counts.sum()), np.int32), np.cumsum(counts)
        for rows, tokens in found:  # the last token of each row comes first
            left[rows] -= 1
            out[left[rows]] = tokens
        return counts, out

    def determinise(self, keys: np.ndarray) -> None:
        """Makes the arcs of keys, all of them new."""
        order = np.argsort(self.size.all[keys >> 8], kind="stable")
        for k in range(0, len(keys), ROWS):
            self.make(keys[order[k : k + ROWS]])

    def make(self, keys: np.ndarray) -> None:
        v = self.vocabulary
        state, letter = keys >> 8, keys & 255
        n, many = self.size.all[state].astype(np.int64), len(keys)
        wide = int(n.max()) + 1
        every = np.arange(many)
        # places 0 to n; nodes[k]: of what begins at place k; last[k]: the token that ends at place k
        nodes, last = np.full((many, wide), -1, np.int32), np.full((many, wide + 1), -1, np.int32)
        inside = np.arange(wide - 1) < n[:, None]
        held = spans(self.at.all[state], n)
        nodes[:, :-1][inside] = self.nodes.all[held]
        last[:, 1:-1][inside] = self.last.all[held]
        last[:, 0] = self.settled.all[state]
        nodes[every, n] = 0
        row, place = np.nonzero(nodes >= 0)
        nodes[row, place] = v.child(nodes[row, place], letter[row])
        # the token that ends here: the longest that can stand beside what precedes it
        row, place = np.nonzero(nodes >= 0)
        token = v.token[nodes[row, place]]
        can = (token >= 0) & v.stands[token]
        row, place, token = row[can], place[can], token[can]
        left = last[row, place]
        seam = np.flatnonzero(left >= 0)
        ok = np.ones(len(row), bool)
        ok[seam] = v.beside(left[seam], token[seam])
        row, place, token = row[ok], place[ok], token[ok]
        longest = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        last[every, n + 1] = token[longest]
        # places at which a token may still begin, and the end, go back until they meet
        nodes[nodes >= 0] = np.where(v.goes_on[nodes[nodes >= 0]], nodes[nodes >= 0], -1)
        heads = np.zeros((many, wide + 1), bool)
        heads[:, :-1] = nodes >= 0
        heads[every, place[longest]] = True
        used, count = heads.copy(), heads.sum(axis=1)
        used[every, n + 1] = True
        for k in range(wide, 0, -1):
            moving = np.flatnonzero(heads[:, k] & (count > 1))
            if len(moving):
                to = k - v.length[last[moving, k]]
                heads[moving, k] = False
                count[moving] -= heads[moving, to]
                heads[moving, to] = used[moving, to] = True
        meet = heads.argmax(axis=1)
        counts, tokens = self.back(last, meet)
        # what stays begins where they meet
        size = n + 1 - meet
        rows = np.full((many, 2 + 2 * int(size.max())), -1, np.int32)
        rows[:, 0], rows[:, 1] = np.where(nodes[every, meet] >= 0, last[every, meet], -1), size
        last[~used] = -1
        inside = np.arange(int(size.max())) < size[:, None]
        whose = np.repeat(every, size)
        from_ = spans(meet, size)
        rows[:, 2::2][inside] = nodes[whose, from_]
        rows[:, 3::2][inside] = last[whose, from_ + 1]
        self.arcs.add(keys)
        self.emit_at.extend(self.emitted.n + np.cumsum(counts) - counts)
        self.emit_n.extend(counts)
        self.emitted.extend(tokens)
        self.next.extend(self.states(rows))

    def arc(self, keys: np.ndarray) -> np.ndarray:
        found = self.arcs.find(keys)
        if len(missing := np.flatnonzero(found < 0)):
            self.determinise(np.unique(keys[missing]))
            found[missing] = self.arcs.find(keys[missing])
        return found

    def run(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """The number of tokens of each pretoken (size bytes of data from begin), and all their ids one after the other."""
        if self.arcs.n > self.most:
            self.forget()
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        state, counts, steps = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), []
        active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1 if len(size) else 1), side="right")  # pretokens that have a byte at a step
        for k, many in enumerate(active.tolist()):
            if many <= FEW:
                break
            arc = self.arc(state[:many] << 8 | data[begin[:many] + k])
            state[:many] = self.next.all[arc]
            emitting = np.flatnonzero(self.emit_n.all[arc])
            if len(emitting):
                arc = arc[emitting]
                counts[emitting] += self.emit_n.all[arc]
                steps.append((emitting, self.emit_at.all[arc], self.emit_n.all[arc]))
        else:
            k = len(active)
        for x in range(int(active[k]) if k < len(active) else 0):
            steps.append(self.follow(x, data[begin[x] + k : begin[x] + size[x]].tolist(), state))
            counts[x] += steps[-1][2].sum()
        counts += self.rest_n.all[state]
        out = np.empty(len(order), np.int64)
        out[order] = counts
        if not ids:
            return out, None
        at = np.empty(len(order), np.int64)  # where the next ids of a pretoken go
        at[:] = (np.cumsum(out) - out)[order]
        flat = np.empty(int(out.sum()), np.int32)
        every = np.arange(len(order))
        for who, from_, many in (*steps, (every, self.rest_at.all[state], self.rest_n.all[state])):
            many = many.astype(np.int64)
            if len(who) > 1 and who[0] == who[-1]:  # one that was followed alone
                flat[at[who[0]] : at[who[0]] + many.sum()] = self.emitted.all[spans(from_, many)]
            else:
                flat[spans(at[who], many)] = self.emitted.all[spans(from_, many)]
            np.add.at(at, who, many)
        return out, self.vocabulary.ids[flat]

    def follow(self, who: int, letters: list[int], state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One pretoken byte by byte from its state, where hardly any other is as long."""
        now, arcs, known = int(state[who]), [], self.followed
        for b in letters:
            key = now << 8 | b
            arc = known.get(key)
            if arc is None:
                if len(known) > self.most:
                    known.clear()
                arc = known[key] = int(self.arc(np.array([key]))[0])
            now = int(self.next.data[arc])
            arcs.append(arc)
        state[who] = now
        arcs = np.array(arcs, np.int64)
        emitting = arcs[self.emit_n.all[arcs] > 0]
        return np.full(len(emitting), who), self.emit_at.all[emitting], self.emit_n.all[emitting]
