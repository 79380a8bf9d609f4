"""Byte-level BPE by corpus-level merge replay.

The distinct pieces of a batch are laid out in one symbol array. An inverted index from merge rank (that is, from token
pair) to positions is built once; then every merge is applied in rank order at all its positions together, and only the
neighbours it touches get new index entries. Texts are then spelled from the replayed pieces.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellstream.llm.common import arrow_map, row_steps

#: Code points whose new pieces are replayed together.
STEP_CHARS = 8_000_000
#: Pieces that are spelled out together.
OUT_PIECES = 100_000
NONE = np.iinfo(np.int32).max
DEAD = NONE - 1


class Merges:
    """Which pairs merge: rank and resulting symbol of a pair."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray):
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], rank.astype(np.int32)[order]
        self.made = dict(zip(rank.tolist(), made.tolist(), strict=True))
        # a hash table of one probe in most cases: slot -> index of a key
        self.bits = max(8, int(len(keys) * 8).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        slot = self._slot(self.keys)
        self.table[slot] = np.arange(len(keys), dtype=np.int32)
        clash = self.table[slot] != np.arange(len(keys), dtype=np.int32)
        self.more = np.zeros(1 << self.bits, bool)
        self.more[slot[clash]] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it doesn't merge."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(keys)
        at = self.table[slot]
        hit = (at >= 0) & (self.keys[at] == keys)
        out = np.where(hit, self.rank[at], np.int32(NONE))
        again = np.flatnonzero(~hit & self.more[slot])
        if len(again):
            at = np.minimum(np.searchsorted(self.keys, keys[again]), len(self.keys) - 1)
            out[again] = np.where(self.keys[at] == keys[again], self.rank[at], np.int32(NONE))
        return out


def replay(symbols: np.ndarray, lengths: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Apply all merges to words laid end to end.

    Returns the symbols left, how many of them each word has, and which words met a merge out of rank order (a merge
    that made a pair of lower rank while the same rank still had positions there), which the caller encodes alone.
    """
    n = len(symbols)
    odd = np.zeros(len(lengths), bool)
    if n == 0:
        return symbols, lengths.copy(), odd
    sym = symbols.astype(np.int32)
    after = np.arange(1, n + 1, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)
    ends = np.cumsum(lengths)
    full = lengths > 0
    after[ends[full] - 1] = -1
    before[(ends - lengths)[full]] = -1
    word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    rank = np.full(n, NONE, np.int32)
    inner = np.flatnonzero(after >= 0)
    rank[inner] = merges.ranks(sym[inner], sym[inner + 1])

    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(positions: np.ndarray) -> None:
        r = rank[positions]
        live = r < DEAD
        positions, r = positions[live], r[live]
        if len(r) == 0:
            return
        if len(r) > 1:
            order = np.argsort(r)
            positions, r = positions[order], r[order]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            begins, heads = [0, *cut.tolist(), len(r)], r[np.concatenate(([0], cut))].tolist()
        else:
            begins, heads = [0, 1], r.tolist()
        for k, head in enumerate(heads):
            part = positions[begins[k] : begins[k + 1]]
            if (held := index.get(head)) is None:
                index[head] = [part]
                heapq.heappush(heap, head)
            else:
                held.append(part)

    add(inner)
    while heap:
        r = heapq.heappop(heap)
        parts = index.pop(r)
        at = parts[0] if len(parts) == 1 else np.concatenate(parts)
        at = at[rank[at] == r]
        if len(at) == 0:
            continue
        if len(at) > 1:
            at.sort()
            at = at[np.concatenate(([True], at[1:] != at[:-1]))]
        made = merges.made[r]
        if len(at) > 1 and (after[at[:-1]] == at[1:]).any():  # as in `aaa`: from the left
            keep, last = [], -1
            for p, q in zip(at.tolist(), after[at].tolist(), strict=True):
                if p != last:
                    keep.append(p)
                    last = q
                else:
                    last = -1
            at = np.array(keep, at.dtype)
        gone = after[at]
        follow = after[gone]
        sym[at] = made
        after[at] = follow
        has = follow >= 0
        before[follow[has]] = at[has]
        rank[gone] = DEAD
        rank[at[~has]] = NONE
        ahead = before[at]
        touched = np.concatenate((ahead[ahead >= 0], at[has]))
        if len(touched):
            fresh = merges.ranks(sym[touched], sym[after[touched]])
            rank[touched] = fresh
            low = fresh <= r
            if low.any():
                odd[word[touched[low]]] = True
            add(touched)
    left = rank != DEAD
    counts = np.bincount(word[left], minlength=len(lengths))
    return sym[left], counts, odd


def joined_rows(ids: np.ndarray, counts: np.ndarray, rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of rows (lists of word numbers) end to end and how many each has; `ids` has those of the words end to end."""
    return joined_words(ids, counts, np.array([i for r in rows for i in r], np.int64), np.array([len(r) for r in rows], np.int64))


def joined_words(ids: np.ndarray, counts: np.ndarray, every: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for rows told as the word numbers of all, end to end, and how many words each has."""
    begins = np.cumsum(counts) - counts
    each = counts[every]
    total = np.concatenate(([0], np.cumsum(each)))
    where = np.repeat(begins[every] - total[:-1], each) + np.arange(total[-1])
    bounds = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    return ids[where], np.diff(total[bounds])


class Speller:
    """Keeps the tokens of pieces seen; new pieces are replayed together. Forgets all beyond `limit` pieces."""

    def __init__(self, encode_pieces, limit: int = 200_000):
        self.encode_pieces, self.limit = encode_pieces, limit
        self.clear()

    def clear(self) -> None:
        self.index: defaultdict[str, int] = defaultdict(count().__next__)
        self.flat = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)

    def spell(self, texts: Iterable[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of texts (lists of pieces) end to end, and how many each text has, for some texts at a time in order."""
        if len(self.index) > self.limit:
            self.clear()
        known = len(self.index)
        number = self.index.__getitem__  # a new piece gets the next number
        rows = [np.fromiter(map(number, pieces), np.int32, len(pieces)) for pieces in texts]
        fresh = list(islice(self.index, known, None))
        if fresh:
            ids, counts = self.encode_pieces(fresh)
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(counts) - counts))
            self.count = np.concatenate((self.count, counts.astype(np.int32)))
            self.flat = np.concatenate((self.flat, ids.astype(np.uint32)))
            del fresh, ids, counts
        ends = np.cumsum([len(r) for r in rows])
        begin = 0
        while begin < len(rows):
            done = ends[begin] - len(rows[begin])
            end = max(begin + 1, int(np.searchsorted(ends, done + OUT_PIECES, side="right")))
            every = np.concatenate(rows[begin:end])
            lengths = self.count[every]
            total = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
            where = np.repeat(self.start[every] - total[:-1], lengths)
            where += np.arange(total[-1])
            bounds = np.concatenate(([0], ends[begin:end] - done))
            yield self.flat[where], np.diff(total[bounds])
            begin = end


#: White_Space of Unicode, as the tokenizer's `\s` has it.
SPACES = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_UNITS = re.compile(rf" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


def byte_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class ByteBpe:
    """The encoding of a file of ranks (`token rank` in base64 lines) under a splitting pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = byte_ranks(path)
        self.pattern = regex.compile(pattern)
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        # several pairs may make one token; they share its rank, and so its entry in the inverted index
        self.merges = Merges(np.array(left), np.array(right), np.array(rank), np.array(rank))
        self.speller = Speller(self.pieces)

    def alone(self, piece: bytes) -> list[int]:
        """One piece by the plain rule: merge the leftmost pair of lowest token rank, again and again."""
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            best = min((self.ranks.get(parts[k] + parts[k + 1], NONE), k) for k in range(len(parts) - 1))
            if best[0] == NONE:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def pieces(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units (text between which the pattern always splits) end to end, and how many each has."""
        split = self.pattern.findall
        words: dict[str, int] = {}
        rows = [[words.setdefault(m, len(words)) for m in split(u)] for u in units]
        raw = [w.encode("utf-8", "replace") for w in words]
        lengths = np.array([len(r) for r in raw], np.int64)
        flat = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        ids, counts, odd = replay(flat, lengths, self.merges)
        alone = {int(k): np.array(self.alone(raw[k]), np.int32) for k in np.flatnonzero(odd)}
        if alone:
            begins = np.cumsum(counts) - counts
            spelled = [alone.get(k) if k in alone else ids[begins[k] : begins[k] + counts[k]] for k in range(len(raw))]
            ids = np.concatenate(spelled)
            counts = np.array([len(s) for s in spelled], np.int64)
        return joined_rows(ids, counts, rows)

    def encode(self, texts: list[str]) -> Iterator[list[np.ndarray]]:
        """Ids (unsigned 32-bit) of the texts, for some of them at a time in order."""
        for ids, counts in self.speller.spell(_UNITS.findall(t) for t in texts):
            yield np.split(ids, np.cumsum(counts)[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def _byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Token ids of every whole text, and the bytes they decode to.

    Returns key, ids array<bigint>, decoded binary. A null text counts as empty and gives no ids; a null key stays;
    repeated rows give a row each, an empty table none; very long texts are encoded whole; other columns are left out.
    Texts with a lone surrogate have it as `?`.
    `path` must exist on every executor (it is read there).
    """
    return _encoded(docs, path, pattern, text, key, digests=False)


def encode_digests(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """As `encode_documents`, but n_tokens and SHA-256 of the ids (little-endian uint32) and of the decoded bytes."""
    return _encoded(docs, path, pattern, text, key, digests=True)


def _encoded(docs: DataFrame, path: str, pattern: str, text: str, key: str, digests: bool) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    made = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids array<bigint>, decoded binary"

    def run(batch: pa.RecordBatch):
        bpe = _byte_bpe(path, pattern)
        for part in row_steps(batch, text, STEP_CHARS):
            begin = 0
            for rows in bpe.encode([t or "" for t in part.column(text).to_pylist()]):
                decoded = [bpe.decode(r) for r in rows]
                if digests:
                    columns = [
                        pa.array([len(r) for r in rows], pa.int64()),
                        pa.array([hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows], pa.string()),
                        pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
                    ]
                    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    columns = [pa.array([r.astype(np.int64) for r in rows], pa.list_(pa.int64())), pa.array(decoded, pa.binary())]
                    names = ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(begin, len(rows)), *columns], [key, *names])
                begin += len(rows)

    return arrow_map(docs.select(F.col(key), F.col(text)), run, f"`{key}` {kind}, {made}")
