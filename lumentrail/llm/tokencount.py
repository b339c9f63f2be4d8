"""Token counts by a finite-state transducer compiled from a byte-level BPE vocabulary.

Byte pair encoding has two properties that make it finite-state (Berglund and van der Merwe 2023): the
tokens of a prefix that ends at a token boundary are the prefix's own tokens, and a sequence of tokens
is the encoding of its bytes exactly if each two neighbours are. So the last token at each position
follows from the last tokens at those earlier positions from which a token may still be under way. These
are the transducer's state, over bytes; a transition carries the change of the number of tokens, which
may be negative. States and transitions are made when first met and kept in a table.

A pretoken (the split before merging) starts in the initial state. Bytes are cut into chunks of fixed
length that run side by side, one table look-up per byte and step. From its first pretoken start on, a
chunk's map from incoming to outgoing state is constant; the part before that start is run when the
incoming state is known, by a scan that composes the maps of the chunks.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentrail.llm import words as W
from lumentrail.llm.shared import text_batches

CHUNK = 256
SPREAD = 0x9E3779B97F4A7C15
#: With so many states the table starts anew, which bounds its memory.
MOST_STATES = 250_000


@cache
def char_classes() -> np.ndarray:
    """Class of every code point: 0 other, 1 letter, 2 number, 3 space, 4 other white space."""
    out = np.zeros(0x110000, np.uint8)
    chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for value, pattern in ((1, r"\p{L}"), (2, r"\p{N}"), (4, r"\p{White_Space}")):
        out[np.frombuffer("".join(regex.findall(pattern, chars)).encode("utf-32-le"), np.uint32)] = value
    out[32] = 3
    return out


OTHER, LETTER, NUMBER, BLANK, WHITE, EDGE = range(6)


def pretoken_starts(cps: np.ndarray, edge_before: np.ndarray, edge_after: np.ndarray) -> np.ndarray:
    """Which code points begin a pretoken of
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

    Whether one does depends on its neighbours alone: a space joins what follows, of several white space
    characters only the last before other text stands apart, and an apostrophe after anything but a space
    or a symbol may begin a contraction, after which another pretoken begins.
    """
    n = len(cps)
    c = char_classes()[cps]
    prev, nxt = np.full(n, EDGE, np.uint8), np.full(n, EDGE, np.uint8)
    prev[1:], nxt[:-1] = c[:-1], c[1:]
    prev[edge_before], nxt[edge_after] = EDGE, EDGE
    white, white_prev = (c == BLANK) | (c == WHITE), (prev == BLANK) | (prev == WHITE)
    solid_next = (nxt != BLANK) & (nxt != WHITE) & (nxt != EDGE)
    start = np.where(white, ~white_prev | solid_next, (prev != c) & (prev != BLANK))
    quote = np.flatnonzero((cps == 39) & (prev != OTHER) & (prev != BLANK))
    if len(quote):
        padded = np.concatenate([cps, np.zeros(2, cps.dtype)])
        one, two = padded[quote + 1].copy(), padded[quote + 2].copy()
        one[edge_after[quote]] = 0
        two[(one == 0) | edge_after[np.minimum(quote + 1, n - 1)]] = 0
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")])
        size = np.where(short, 2, np.where(long, 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        after = quote + size
        after = after[after < n]
        # white space after a contraction keeps its own rule, which makes it begin a pretoken anyway
        start[after] = True
    return start


class Transducer:
    """The compiled vocabulary. ``vocab``: bytes of each token and its rank among merges' results."""

    def __init__(self, tokens: dict[bytes, int], merges: dict[tuple[bytes, bytes], int] | None):
        self.tokens, self.merges = tokens, merges
        self.prefixes = {t[:i] for t in tokens for i in range(1, len(t))} | {b""}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.own: dict[bytes, bool] = {}
        self.reset()

    def reset(self) -> None:
        start = (b"", ((0, None, 0),))
        self.states, self.index = [start], {start: 0}
        self.used = 0
        self._allot(1 << 16)

    def _allot(self, size: int) -> None:
        """An open-addressing table of transitions: key (state and byte), next state, change of the count."""
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.mask = size - 1
        self.keys = np.full(size, -1, np.int64)
        self.next = np.zeros(size, np.int32)
        self.delta = np.zeros(size, np.int8)

    def _insert(self, key: int, to: int, change: int) -> None:
        if 2 * self.used >= len(self.keys):
            old = self.keys, self.next, self.delta
            self._allot(2 * len(self.keys))
            for i in np.flatnonzero(old[0] >= 0):
                self._put(int(old[0][i]), int(old[1][i]), int(old[2][i]))
        self._put(key, to, change)
        self.used += 1

    def _put(self, key: int, to: int, change: int) -> None:
        slot = (key * SPREAD & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while self.keys[slot] >= 0:
            slot = (slot + 1) & self.mask
        self.keys[slot], self.next[slot], self.delta[slot] = key, to, change

    def encode(self, data: bytes) -> list[bytes]:
        """Plain byte pair encoding: the pair of least rank, leftmost first, is merged until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            if self.merges is None:
                ranks = [self.tokens.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            else:
                ranks = [self.merges.get(p) for p in zip(parts, parts[1:], strict=False)]
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fits(self, left: bytes | None, token: bytes) -> bool:
        if (ok := self.own.get(token)) is None:
            ok = self.own[token] = self.encode(token) == [token]
        if not ok or left is None:
            return ok
        if (ok := self.pairs.get((left, token))) is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            ok = self.pairs[left, token] = self.encode(left + token) == [left, token]
        return ok

    def _step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        text, places = state
        text += bytes([byte])
        for back, last, count in places:  # longest token first
            token = text[len(text) - back - 1 :]
            if token in self.tokens and self._fits(last, token):
                break
        else:
            raise ValueError("the vocabulary lacks single bytes")
        change = count + 1
        kept = [(back + 1, last, count - change) for back, last, count in places if text[len(text) - back - 1 :] in self.prefixes]
        kept.append((0, token, 0))
        return (text[len(text) - kept[0][0] :], tuple(kept)), change

    def _learn(self, state: int, byte: int) -> None:
        new, change = self._step(self.states[state], byte)
        if (i := self.index.get(new)) is None:
            i = self.index[new] = len(self.states)
            self.states.append(new)
        self._insert(state << 8 | byte, i, change)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Slot of each key, or the empty slot where it would go."""
        slot = ((key.view(np.uint64) * np.uint64(SPREAD)) >> self.shift).view(np.int64)
        kept = self.keys[slot]
        on = np.flatnonzero((kept != key) & (kept >= 0))
        while on.size:
            slot[on] = (slot[on] + 1) & self.mask
            kept = self.keys[slot[on]]
            on = on[(kept != key[on]) & (kept >= 0)]
        return slot

    def _advance(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One byte for each of several chunks."""
        key = (state.astype(np.int64) << 8) | byte
        slot = self._find(key)
        if (miss := np.flatnonzero(self.keys[slot] < 0)).size:
            for k in np.unique(key[miss]).tolist():
                self._learn(k >> 8, k & 255)
            slot = self._find(key)
        return self.next[slot], self.delta[slot]

    def changes(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each byte the change of the token count; ``starts`` marks the bytes that begin a pretoken."""
        if len(self.states) > MOST_STATES:
            self.reset()
        n = len(data)
        lanes = -(-n // CHUNK)
        grid = np.zeros(lanes * CHUNK, np.uint8)
        grid[:n] = data
        grid[n:] = data[-1] if n else 0
        fresh = np.zeros(lanes * CHUNK, bool)
        fresh[:n] = starts
        fresh[n:] = True
        grid, fresh = np.ascontiguousarray(grid.reshape(lanes, CHUNK).T), np.ascontiguousarray(fresh.reshape(lanes, CHUNK).T)
        out = np.zeros((CHUNK, lanes), np.int8)
        # the constant part of each chunk's map
        state = np.full(lanes, -1, np.int32)
        for j in range(CHUNK):
            state[fresh[j]] = 0
            if (on := np.flatnonzero(state >= 0)).size == lanes:
                state, out[j] = self._advance(state, grid[j])
            elif on.size:
                state[on], out[j, on] = self._advance(state[on], grid[j, on])
        # the scan: a chunk's head runs as soon as the chunk before it has an outgoing state
        head = np.where(fresh.any(axis=0), fresh.argmax(axis=0), CHUNK)
        waiting = np.flatnonzero(head > 0)
        while waiting.size:
            ready = waiting[state[waiting - 1] >= 0]
            waiting = waiting[state[waiting - 1] < 0]
            s = state[ready - 1].copy()
            for j in range(int(head[ready].max())):
                on = np.flatnonzero(head[ready] > j)
                s[on], out[j, ready[on]] = self._advance(s[on], grid[j, ready[on]])
            through = head[ready] == CHUNK
            state[ready[through]] = s[through]
        return out.T.reshape(-1)[:n]


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of bytes in .json vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def load(path: str) -> tuple[Transducer, tuple[bytes, ...]]:
    """The transducer of a vocabulary file, and its special strings, kept for the life of the process.

    ``.json``: byte-level BPE with the usual split and no normalizer; ``.tiktoken``: ranks of the same kind.
    """
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            return Transducer({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, None), ()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    byte_of = _byte_of()
    raw = lambda s: bytes(byte_of[c] for c in s)
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    merges = {(raw(a), raw(b)): i for i, (a, b) in reversed([*enumerate(pairs)])}
    return Transducer({raw(t): i for t, i in model["vocab"].items()}, merges), tuple(t["content"].encode() for t in spec["added_tokens"])


def count_tokens(data: np.ndarray, off: np.ndarray, path: str) -> np.ndarray:
    """The number of tokens of each text. Special strings inside a text are one token each, as in the library."""
    transducer, special = load(path)
    out = np.zeros(len(off) - 1, np.int64)
    for i, j, part, at in W.blocks(data, off, 1 << 20):
        if not len(part):
            continue
        raw = part.tobytes()
        cps = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((part & 0xC0) != 0x80)
        first = np.zeros(len(part) + 1, bool)
        first[at[:-1]] = True
        spots = []
        for s in special:
            k = raw.find(s)
            while k >= 0:
                row = int(np.searchsorted(at, k, "right"))
                if k + len(s) <= at[row]:
                    spots.append((k, k + len(s)))
                    first[[k, k + len(s)]] = True
                    k = raw.find(s, k + len(s))
                else:
                    k = raw.find(s, k + 1)
        before = first[lead]
        after = np.empty_like(before)
        after[:-1], after[-1] = before[1:], True
        starts = np.zeros(len(part), bool)
        starts[lead[pretoken_starts(cps, before, after)]] = True
        change = transducer.changes(part, starts).astype(np.int64)
        for a, b in spots:
            change[a:b] = 0
            change[a] = 1
        total = np.concatenate([[0], np.cumsum(change)])
        out[i:j] = total[at[1:]] - total[at[:-1]]
    return out


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row, over its whole text.

    Null and empty texts have 0 bytes and 0 tokens. Rows are independent of each other, so repeated rows, ids
    and null ids come back as they are. ``path`` must exist on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = W.utf8(b.column(1))
            n = count_tokens(data, off, path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
