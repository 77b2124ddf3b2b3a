"""Encoding of whole texts by memoised chunks, in bulk.

No token of a byte-level or word-level pre-tokenizer crosses the border before the last white-space character of a run,
where that is a space or a line feed: what stands before it ends as at the end of a text, what follows begins with it.
Texts are cut there and each distinct chunk is encoded once per worker. Chunks are found, looked up and put together in
arrays; keys are the chunks' own bytes, so nothing rests on a hash. The memo is bounded: memory doesn't grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

from wirespark.llm.common import slabs

#: Longer chunks (bytes) are encoded whenever they occur, but not kept.
LONGEST_KEPT = 32
#: Characters in UTF-8 that are white space outside ASCII, by lead byte: the following bytes as one number.
WIDE_SPACES = {0xC2: [0x85, 0xA0], 0xE1: [0x9A80], 0xE2: [*range(0x8080, 0x808B), 0x80A8, 0x80A9, 0x80AF, 0x819F], 0xE3: [0x8080]}
ORDINARY, SPACE, LINE, WHITE, PERHAPS = range(5)


def _kinds(separators_too: bool) -> np.ndarray:
    kinds = np.full(256, ORDINARY, np.uint8)
    kinds[[9, 11, 12, 13]] = WHITE
    if separators_too:  # white space to some, not to others
        kinds[0x1C:0x20] = WHITE
        kinds[list(WIDE_SPACES)] = PERHAPS
    kinds[32], kinds[10] = SPACE, LINE
    return kinds


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class ChunkEncoder:
    """encode_many(chunks) -> list of bytes (packed ids of type `wide`).

    spaced: tokens hold the space before them, and a chunk begins with its space or line feed (the first of a text with
    what it has). Otherwise white space doesn't matter, and chunks have none around them.
    """

    COLUMNS = LONGEST_KEPT // 8

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], wide: np.dtype, spaced: bool = True, most: int = 500_000):
        self.encode_many, self.wide, self.spaced, self.most = encode_many, np.dtype(wide), spaced, most
        self.bits = max(10, (2 * most).bit_length())
        self.kinds = _kinds(spaced)
        self._clear()

    def _clear(self) -> None:
        self.seen = self.missed = self.n = self.used = 0
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.zeros((1 << 12, self.COLUMNS), np.uint64)
        self.at, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.pool = np.zeros(1 << 14, self.wide)

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for group in slabs(texts):
            yield from self._slab([x.encode() for x in group])

    def _borders(self, b: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where chunks begin and end; every text is followed by a tab."""
        kinds = self.kinds[b]
        if not self.spaced:
            inside = kinds == ORDINARY
            edge = np.diff(inside, prepend=False)
            at = np.flatnonzero(edge)
            return at[::2], at[1::2]
        first = np.zeros(len(b), bool)
        border = (kinds[:-1] == SPACE) | (kinds[:-1] == LINE)
        first[:-1] = border & (kinds[1:] == ORDINARY)
        perhaps = np.flatnonzero(border & (kinds[1:] == PERHAPS))
        if len(perhaps):
            lead, two = b[perhaps + 1], b[perhaps + 2].astype(np.int64)
            three = two << 8 | b[np.minimum(perhaps + 3, len(b) - 1)]
            white = np.zeros(len(perhaps), bool)
            for x, rest in WIDE_SPACES.items():
                white |= (lead == x) & np.isin(two if x == 0xC2 else three, rest)
            first[perhaps[~white]] = True
        first[starts] = True
        begin = np.flatnonzero(first)
        end = np.empty_like(begin)
        end[:-1] = begin[1:]
        last = np.append(np.searchsorted(begin, starts[1:]) - 1, len(begin) - 1)
        end[last] = starts + sizes
        return begin, end

    def _key(self, data: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The bytes of chunks as rows of numbers; those of long ones are cut."""
        keys = np.zeros((len(begin), self.COLUMNS), np.uint64)
        rows = slice(None)
        for c in range(self.COLUMNS):
            if c:
                rows = np.flatnonzero(sizes > 8 * c)
            at = begin[rows] + 8 * c
            low, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
            x = data[low] >> shift | data[low + 1] << np.uint64(1) << (np.uint64(63) - shift)
            keys[rows, c] = x & _MASKS[np.minimum(sizes[rows] - 8 * c, 8)]
        return keys

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        x = keys[:, 0] * _FACTORS[0]
        for c in range(1, self.COLUMNS):
            x ^= keys[:, c] * _FACTORS[c]
        x ^= x >> np.uint64(32)
        return ((x * _FACTORS[0]) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        out, todo, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), slot.copy()
        while len(todo):
            entry = self.slots[slot]
            there = self.keys[entry]
            wanted = keys if len(todo) == len(keys) else keys[todo]
            other = there[:, 0] ^ wanted[:, 0]
            for c in range(1, self.COLUMNS):
                other |= there[:, c] ^ wanted[:, c]
            hit = (other == 0) & (entry >= 0)
            out[todo[hit]] = entry[hit]
            go = ~hit & (entry >= 0)
            todo, slot = todo[go], slot[go] + 1 & (1 << self.bits) - 1
        return out

    def _grow(self, name: str, size: int) -> None:
        old = getattr(self, name)
        if size > len(old):
            new = np.zeros((max(size, len(old) * 3 // 2), *old.shape[1:]), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def _keep(self, keys: np.ndarray, slot: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
        """Enter new keys, all different."""
        n = self.n + len(keys)
        for name in ("keys", "at", "count"):
            self._grow(name, n)
        self.keys[self.n : n], self.at[self.n : n], self.count[self.n : n] = keys, at, count
        entry, slot = np.arange(self.n, n, dtype=np.int32), slot.copy()
        while len(entry):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entry[free]
            left = self.slots[slot] != entry
            entry, slot = entry[left], slot[left] + 1 & (1 << self.bits) - 1
        self.n = n

    def _slab(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if self.missed * 3 > self.seen and self.seen > 400_000 and self.n * 10 > self.most * 9:
            self._clear()  # it serves badly: the texts have changed
        self.seen, self.missed = self.seen // 2, self.missed // 2
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(sizes + 1) - sizes - 1
        raw = b"\t".join([*texts, b""])
        padded = raw + bytes(16 + LONGEST_KEPT - len(raw) % 8)
        b, data = np.frombuffer(raw, np.uint8), np.frombuffer(padded, "<u8", len(padded) // 8)
        begin, end = self._borders(b, starts, sizes)
        length = end - begin
        keys = self._key(data, begin, length)
        slot = self._slot(keys)
        entry = self._find(keys, slot)
        short = length <= LONGEST_KEPT
        if b"\0" in raw:  # keys are padded with zeros
            short[np.searchsorted(begin, np.flatnonzero(b == 0), "right") - 1] = False
        entry[~short] = -1
        new = np.flatnonzero(entry < 0)
        self.seen += len(begin)
        self.missed += len(new)
        at, count = self.at[entry], self.count[entry].astype(np.int64)
        used = self.used
        if len(new):
            number: dict[bytes, int] = {}
            which = [number.setdefault(raw[x:y], len(number)) for x, y in zip(begin[new].tolist(), end[new].tolist())]
            codes = self.encode_many([x.decode() for x in number])
            ids = np.frombuffer(b"".join(codes), self.wide)
            counts = np.fromiter(map(len, codes), np.int64, len(codes)) // self.wide.itemsize
            places = used + np.cumsum(counts) - counts
            self._grow("pool", used + len(ids))
            self.pool[used : used + len(ids)] = ids
            which = np.array(which)
            at[new], count[new] = places[which], counts[which]
            fits = np.flatnonzero(short[new])
            row, first = np.unique(which[fits], return_index=True)
            if self.n + len(row) <= self.most:  # frequent chunks come early, so a full memo keeps what it has
                kept = new[fits[first]]
                self._keep(keys[kept], slot[kept], places[row], counts[row])
                self.used = used + len(ids)
        ends = np.cumsum(count)
        place = np.repeat(at - (ends - count), count)
        place += np.arange(len(place))
        out = self.pool[place]
        bounds = np.append(0, ends)[np.append(np.searchsorted(begin, starts), len(begin))].tolist()
        for x, y in zip(bounds, bounds[1:]):
            yield out[x:y]
