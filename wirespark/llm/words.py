"""Token ids of whole texts by a file of the tokenizers library, in bulk.

Texts are cut into chunks (module chunks). Chunks that are one run of Latin letters, perhaps after a space or line feed
and before punctuation, are one word to the pre-tokenizer whatever stands around them; the words that a batch brings for
the first time are merged side by side in arrays. All other chunks pass the library's whole chain.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np

from wirespark.llm.chunks import ChunkEncoder
from wirespark.llm.common import held

#: A word of Latin letters that lower-case one to one and need no normal form, with what may stand around it in a chunk.
PLAIN = re.compile("(\n?)( ?[A-Za-zÀ-ÖØ-öø-įı-ɏ]{1,48})([!-/:-@\\[-`{-~]*\n*)")
NEVER = np.iinfo(np.int32).max


def byte_symbols() -> dict[int, str]:
    """The character by which byte-level vocabularies show each byte: printable ones as they are, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Merges:
    """The merges of a vocabulary as a hash table in arrays: pair of ids -> rank and the id that the merge makes."""

    BITS = 18

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model["type"] != "BPE" or any(model.get(x) for x in ("dropout", "byte_fallback", "fuse_unk", "continuing_subword_prefix", "ignore_merges")):
            raise ValueError(f"{path} is not a plain byte-pair vocabulary")
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[symbols[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[symbols[b] + end] for b in range(256)], np.int32)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        if len(pairs) << 1 > 1 << self.BITS:
            raise ValueError("more merges than this table is made for")
        left, right = (np.array([vocab[x[k]] for x in pairs], np.int64) for k in (0, 1))
        self.made = np.array([vocab["".join(x)] for x in pairs], np.int32)
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.ranks = np.full(1 << self.BITS, NEVER, np.int32)
        todo, step = np.arange(len(pairs)), 0
        keys = left << 32 | right
        while len(todo):  # linear probing, all that are left at a time
            at = self._slot(keys[todo]) + step & (1 << self.BITS) - 1
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[todo[free]]
            placed = self.keys[at] == keys[todo]
            self.ranks[at[placed]] = todo[placed]
            todo, step = todo[~placed], step + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NEVER for those that don't merge."""
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.ranks[at], NEVER)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            at[todo] = at[todo] + 1 & (1 << self.BITS) - 1
            there = self.keys[at[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        return out

    def encode(self, words: list[str], wide: np.dtype) -> list[bytes]:
        """The ids of each word (none empty, none with a line feed), packed."""
        data = np.frombuffer(("\n".join(words) + "\n").encode(), np.uint8)
        ends = np.flatnonzero(data == 10)
        sizes = np.diff(ends, prepend=-1) - 1
        order, out = np.argsort(sizes, kind="stable"), [b""] * len(words)
        for a in range(0, len(order), 4096):
            rows = order[a : a + 4096]
            flat, counts = self._merged(data, ends[rows] - sizes[rows], sizes[rows])
            packed = flat.astype(wide).tobytes()
            stops = (np.cumsum(counts) * wide.itemsize).tolist()
            begin = 0
            for i, stop in zip(rows.tolist(), stops):
                out[i] = packed[begin:stop]
                begin = stop
        return out

    def _merged(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words as rows of a matrix; in each step every row does its merge of lowest rank, the first of equal ones."""
        n, width = len(sizes), int(sizes[-1])
        columns = np.arange(width)
        stride = width + 2
        values = data[np.minimum(starts[:, None] + columns, len(data) - 1)]
        ids = np.full((n, stride), -1, np.int32)  # a column before and one after
        ids[:, 1:-1] = np.where(columns < sizes[:, None], self.inner[values], -1)
        ends = np.arange(n) * stride + sizes  # flat places from here on
        ids = ids.reshape(-1)
        ids[ends] = self.last[values[np.arange(n), sizes - 1]]
        follow = np.arange(1, len(ids) + 1)
        before = follow - 2
        ranks = np.full(len(ids), NEVER, np.int32)
        pairs = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        ranks[pairs] = self.rank(ids[pairs], ids[pairs + 1])
        rows, table = np.arange(n), ranks.reshape(n, stride)
        while len(rows):
            at = (table if len(rows) == n else table[rows]).argmin(1) + rows * stride
            best = ranks[at]
            go = np.flatnonzero(best < NEVER)
            rows, at, best = rows[go], at[go], best[go]
            gone = follow[at]
            after, prior = follow[gone], before[at]
            ids[at], ids[gone] = self.made[best], -1
            ranks[gone] = NEVER
            follow[at], before[after] = after, at
            one, two = np.append(at, prior), np.append(after, at)
            left, right = ids[one], ids[two]
            found = self.rank(left, right)
            found[(left < 0) | (right < 0)] = NEVER
            ranks[one] = found
        ids = ids.reshape(n, stride)
        return ids[ids >= 0], (ids >= 0).sum(1)


class WordTokens:
    """A tokenizer file of the tokenizers library, asked once for each distinct chunk.

    added: whether the file's added tokens (<|endoftext|>) are found in texts, as the library does by default; texts are
    cut there, and what is between them is encoded as texts of their own. Otherwise they are ordinary characters.
    """

    def __init__(self, path: str, spaced: bool, added: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        self.wide = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        found = self.tokenizer.get_added_tokens_decoder() if added else {}
        if any(x.lstrip or x.rstrip or x.single_word or x.normalized for x in found.values()):
            raise ValueError("added tokens that are not plain literals")
        self.added = {x.content: np.array([k], self.wide) for k, x in found.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        self.spaced, self.merges = spaced, Merges(path)
        self.around: dict[str, bytes] = {"": b""}
        self.chunks = ChunkEncoder(self._encode_many, self.wide, spaced)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.wide).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _encode_many(self, chunks: list[str]) -> list[bytes]:
        cut = list(map(PLAIN.fullmatch, chunks))
        parts = [m.groups() if m else None for m in cut]
        whole = [x for x, p in zip(chunks, parts) if p is None]
        around = self.around
        marks = list({y for p in parts if p for y in (p[0], p[2]) if y not in around})
        if len(around) + len(marks) > 50_000:
            around.clear()
            marks = list({y for p in parts if p for y in (p[0], p[2])})
        around.update(zip(marks, self._whole(marks)))
        around[""] = b""
        words = [p[1] for p in parts if p]
        if not self.spaced:  # that tokenizer lowers case
            words = "\n".join(words).lower().split("\n") if words else []
        words = list(map(str.strip, words)) if not self.spaced else words
        distinct = list(dict.fromkeys(words))
        codes = dict(zip(distinct, self.merges.encode(distinct, self.wide))) if distinct else {}
        words_in, whole_in = iter(words), iter(self._whole(whole))
        return [next(whole_in) if p is None else around[p[0]] + codes[next(words_in)] + around[p[2]] for p in parts]

    def encode(self, texts) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if not self.added:
            yield from self.chunks.encode(texts)
            return
        cut = [self.split(x) if any(a in x for a in self.added) else [x] for x in texts]
        codes = self.chunks.encode(x for parts in cut for x in parts[::2])
        for parts in cut:
            code = [next(codes)]
            for a in parts[1::2]:
                code += [self.added[a], next(codes)]
            yield code[0] if len(code) == 1 else np.concatenate(code)


def tokens_of(path: str, spaced: bool) -> WordTokens:
    """spaced: whether the tokenizer's tokens hold the space before them."""
    return held(("words", path, spaced), lambda: WordTokens(path, spaced, added=True))
