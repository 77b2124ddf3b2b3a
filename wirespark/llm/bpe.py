"""Operator 1: byte-level BPE encoding and decoding by finite-state transducers.

Encoder. A token sequence is the BPE encoding of a byte string just when each two neighbours encode to themselves
(merge tables that build every token from earlier ones have this property). The non-deterministic transducer therefore
has configurations (last token and tokens not yet emitted, bytes read since: a proper prefix of some token); it is
determinised lazily, a set of configurations being one state, and what all configurations of a state agree on is
emitted: at once where one configuration is left, and every LOOKAHEAD bytes what the chains of all of them share. What
is held back is bounded by that and a few longest tokens. States and transitions are kept in a bounded memo.

Decoder. Token bytes pass an incremental UTF-8 state machine whose state is carried from token to token, so text comes
out as soon as its last byte is there and sequences cut at any id can be resumed.

Defined results: null text is the empty text (no ids, sha256 of nothing); repeated rows give repeated results; other
columns of the table are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from wirespark.llm.chunks import ChunkEncoder
from wirespark.llm.common import doc_texts, held, table, without_gc


#: Bytes after which the chains of several configurations are compared.
LOOKAHEAD = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class BpeTransducer:
    """Lazily determinised transducer from bytes to token ids.

    A state is a set of configurations, the longest pending first; the last has nothing pending, and its token is the
    one that ends at this byte. Emitting follows these ends back from the positions at which something can go on.
    """

    def __init__(self, ranks: dict[bytes, int], most_states: int = 250_000):
        self.ranks, self.most_states = ranks, most_states
        self.token_bytes = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.alive = {b[:k] for b in ranks for k in range(1, len(b))}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.configs: list[tuple] = []
        self.ends: list[int] = []
        self.one: list[bool] = []
        self.moves: dict[int, int] = {}
        self._state(((-1, b""),))

    def _state(self, configs: tuple) -> int:
        number = self.states.get(configs)
        if number is None:
            number = self.states[configs] = len(self.configs)
            self.configs.append(configs)
            self.ends.append(configs[-1][0])
            self.one.append(len(configs) == 1)
        return number

    def merge(self, data: bytes, leave: int = 1) -> list[int]:
        """BPE by its definition, down to so many parts: for single tokens, to learn the merge that made them."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > leave:
            best, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one, None for a single byte; -1s for a token that BPE never makes."""
        if token not in self.halves:
            data = self.token_bytes[token]
            parts = self.merge(data, leave=2)
            self.halves[token] = None if len(data) == 1 else tuple(parts) if len(parts) == 2 and self.merge(data) == [token] else (-1, -1)
        return self.halves[token]

    def may_follow(self, left: int, right: int) -> bool:
        """Undo the merges that made the two tokens, latest first: no merge across the border may come before the one undone."""
        ranks, names = self.ranks, self.token_bytes
        if self._parts(right) == (-1, -1):
            return False
        if left < 0:
            return True
        until = 1 << 60
        while True:
            across = ranks.get(names[left] + names[right])
            if across is not None and across < until:
                return False
            halves_left, halves_right = self._parts(left), self._parts(right)
            if halves_left is None and halves_right is None:
                return True
            if halves_right is None or (halves_left is not None and left > right):
                until, left = left, halves_left[1]
            else:  # of equal ranks the left merge comes first, so a merge across comes before the right one at the same rank
                until, right = right + 1, halves_right[0]

    def _move(self, state: int, byte: int) -> int:
        """The state after byte."""
        after, symbol, ended = [], bytes((byte,)), -1
        alive, ranks, fits = self.alive, self.ranks, self.fits
        for last, pending in self.configs[state]:
            grown = pending + symbol
            if ended < 0 and (token := ranks.get(grown)) is not None:  # just one token can end here
                if (fit := fits.get((last, token))) is None:
                    fit = fits[last, token] = self.may_follow(last, token)
                if fit:
                    ended = token
            if grown in alive:
                after.append((last, grown))
        after.append((ended, b""))
        target = self.moves[state << 8 | byte] = self._state(tuple(after))
        return target

    def _back(self, ends: list[int], at: int) -> list[int]:
        """The tokens up to byte `at`, in order; ends has the token that ends at each byte."""
        size, out = self.size, []
        while at > 0:
            token = ends[at - 1]
            out.append(token)
            at -= size[token]
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        return [x for part in self.stream((data,)) for x in part]

    def stream(self, parts: Iterable[bytes]) -> Iterator[list[int]]:
        """Tokens as soon as no later byte can change them."""
        if len(self.fits) > 8 * self.most_states:
            self.fits.clear()
        state, held = 0, []
        for data in parts:
            moves, ends, one = self.moves, self.ends, self.one
            for byte in data:
                found = moves.get(state << 8 | byte)
                state = self._move(state, byte) if found is None else found
                held.append(ends[state])
                if one[state]:
                    yield self._back(held, len(held))
                    held = []
                elif len(held) % LOOKAHEAD == 0:
                    yield self._agreed(held, state)
            if len(self.configs) > self.most_states:
                here = self.configs[state]
                self._reset()
                state = self._state(here)
        if held:
            yield self._back(held, len(held))

    def _agreed(self, held: list[int], state: int) -> list[int]:
        """The tokens that all configurations share; their bytes are no longer held."""
        chains = [self._back(held, len(held) - len(pending)) for _, pending in self.configs[state]]
        shared = min(map(len, chains))
        while any(chain[:shared] != chains[0][:shared] for chain in chains):
            shared -= 1
        sure = chains[0][:shared]
        del held[: sum(self.size[x] for x in sure)]
        return sure


def _utf8_table() -> np.ndarray:
    """next[state, byte]; 0: between characters, 1-3: so many continuation bytes due, 4-7: a second byte of a narrower range is due, 8: fault."""
    t = np.full((9, 256), 8, np.uint8)
    t[0, :0x80] = 0
    t[0, 0xC2:0xE0], t[0, 0xE1:0xF0], t[0, 0xF1:0xF4] = 1, 2, 3
    t[0, 0xE0], t[0, 0xED], t[0, 0xF0], t[0, 0xF4] = 4, 5, 6, 7
    t[1, 0x80:0xC0], t[2, 0x80:0xC0], t[3, 0x80:0xC0] = 0, 1, 2
    t[4, 0xA0:0xC0], t[5, 0x80:0xA0], t[6, 0x90:0xC0], t[7, 0x80:0x90] = 1, 1, 2, 2
    return t


UTF8_NEXT = _utf8_table()
FAULT = 8


class Utf8Stream:
    """Incremental UTF-8 decoding: feed() gives the text whose bytes are complete, close() tells whether nothing is open."""

    def __init__(self):
        self.state, self.held = 0, b""

    def feed(self, data: bytes) -> str:
        state, good, table = self.state, 0, UTF8_NEXT
        for i, byte in enumerate(data):
            state = int(table[state, byte])
            if state == FAULT:
                raise UnicodeDecodeError("utf-8", self.held + data, len(self.held) + i, len(self.held) + i + 1, "not UTF-8")
            if state == 0:
                good = i + 1
        done, self.held = (self.held + data[:good], data[good:]) if good else (b"", self.held + data)
        self.state = state
        return done.decode()

    def close(self) -> bool:
        return self.state == 0


class TokenDecoder:
    """Ids to bytes, a part at a time: feed() gives the bytes of all characters that are complete, close() what is left.

    The state of the UTF-8 machine is carried from token to token; tokens that leave it between characters are known
    beforehand, so only those that split characters are walked. Bytes that are no UTF-8 pass as they are.
    """

    def __init__(self, token_bytes: dict[int, bytes]):
        size = max(token_bytes, default=-1) + 1
        self.table = [token_bytes.get(i, b"") for i in range(size)]
        self.whole = np.array([self._run(0, b) == 0 for b in self.table], bool)
        self.steps: dict[tuple[int, int], int] = {}
        self.start()

    def start(self) -> None:
        self.state, self.held, self.valid = 0, b"", True

    @staticmethod
    def _run(state: int, data: bytes) -> int:
        for byte in data:
            state = int(UTF8_NEXT[state, byte])
        return state

    def feed(self, ids: np.ndarray) -> bytes:
        data = self.held + b"".join(map(self.table.__getitem__, ids.tolist()))
        state, last = self.state, -1
        for i in np.flatnonzero(~self.whole[ids]).tolist():  # all others keep state 0, and are a fault in any other
            if i != last + 1 and state:
                state, self.valid = 0, False
            key = state, int(ids[i])
            if key not in self.steps:
                self.steps[key] = self._run(state, self.table[key[1]])
            state, last = self.steps[key], i
            if state == FAULT:
                state, self.valid = 0, False
        if state and last != len(ids) - 1:
            state, self.valid = 0, False
        cut = len(data)
        if state:  # a character is open: hold it back from its first byte on
            while data[cut - 1] & 0xC0 == 0x80:
                cut -= 1
            cut -= 1
        self.state, self.held = state, data[cut:]
        return data[:cut]

    def close(self) -> bytes:
        self.valid = self.valid and self.state == 0
        rest, self.state, self.held = self.held, 0, b""
        return rest

    def decode(self, ids: np.ndarray, group: int = 1 << 14) -> Iterator[bytes]:
        """The bytes, as they become complete; afterwards `valid` tells whether they are UTF-8."""
        self.start()
        for at in range(0, len(ids), group):
            yield self.feed(ids[at : at + group])
        yield self.close()


class ByteBpe:
    """Pattern split, transducer and decoder together; made once per worker process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.fst = BpeTransducer(ranks)
        self.wide = np.dtype("<u2") if max(ranks.values()) < 1 << 16 else np.dtype("<u4")
        self.packed = "H" if self.wide.itemsize == 2 else "I"
        self.find = regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {}
        self.chunks = ChunkEncoder(self._encode_many, self.wide)
        self.decoder = TokenDecoder(self.fst.token_bytes)
        self.decimal = [str(i) for i in range(max(ranks.values()) + 1)]

    def _piece(self, piece: str) -> bytes:
        code = self.pieces.get(piece)
        if code is None:
            code = array(self.packed, self.fst.encode(piece.encode())).tobytes()
            if len(piece) <= 48:
                if len(self.pieces) > 600_000:
                    self.pieces.clear()
                self.pieces[piece] = code
        return code

    def _encode_many(self, chunks: list[str]) -> list[bytes]:
        piece = self._piece
        return [piece(x) if x[1:].isalpha() and x[0] == " " else b"".join(map(piece, self.find(x))) for x in chunks]

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        yield from self.chunks.encode(texts)


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return held(("bytes", path, pattern), lambda: ByteBpe(load_ranks(path), pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (packed little-endian, 2 bytes each where the vocabulary allows, else 4)."""

    def run(batches):
        codec = byte_bpe(path, pattern)
        for batch in batches:
            codes = [x.tobytes() for x in codec.encode(batch.column("text").to_pylist())]
            yield pa.record_batch([batch.column("doc_id"), pa.array(codes, pa.binary())], ["doc_id", "ids"])

    return doc_texts(docs).mapInArrow(without_gc(run), "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text (null where the bytes are not UTF-8) from what encode_documents gives."""

    def run(batches):
        codec = byte_bpe(path, pattern)
        for batch in batches:
            texts = []
            for code in batch.column("ids").to_pylist():
                data = b"".join(codec.decoder.decode(np.frombuffer(code or b"", codec.wide)))
                texts.append(data.decode() if codec.decoder.valid else None)
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode and digest each whole text in one pass over the table, without a shuffle."""

    def run(batches):
        codec = byte_bpe(path, pattern)
        decimal = codec.decimal
        for batch in batches:
            n, ids_sha, text_sha, valid = [], [], [], []
            for ids in codec.encode(batch.column("text").to_pylist()):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                sha = hashlib.sha256()
                for data in codec.decoder.decode(ids):
                    sha.update(data)
                text_sha.append(sha.hexdigest())
                valid.append(codec.decoder.valid)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(valid, pa.bool_())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "valid_utf8"],
            )

    return doc_texts(docs).mapInArrow(without_gc(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, valid_utf8 boolean")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
