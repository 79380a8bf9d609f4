"""Best-fit packing by large-item matching over the histogram of lengths.

A plan of bins depends on how many pieces have each length only, so it is made from at most `capacity` counters: pieces
above a third of the capacity are matched greedily, two to a bin at most, then shorter ones go to the tightest gap.
Each piece then finds its own place from its length and its rank among pieces of that length.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellstream.llm.bpe import SPACES, STEP_CHARS, Merges, Speller, joined_words, replay
from cellstream.llm.common import arrow_map, checkpointed, row_steps

CAPACITY = 2048

#: Characters at which words may not be told apart by ASCII blanks, or that make special tokens: such texts go whole.
_WHOLE = re.compile(f"[{''.join(map(chr, [*range(0x1C, 0x20), 0x180E, 0xFEFF, *(ord(c) for c in SPACES if ord(c) > 32)]))}]|<[|]")
_PLAIN = re.compile(f"[!-~{chr(0xC0)}-{chr(0xFF)}]+" + r"\Z")
_PLAIN_LINES = re.compile(f"[\n!-~{chr(0xC0)}-{chr(0xFF)}]*" + r"\Z")

#: What makes a text of Latin-1 go whole, and the lower case of its characters, which doesn't depend on their neighbours
#: and commutes with NFC there (not beyond: h and U+0331 compose, H and U+0331 don't).
_WHOLE_LATIN = ("<|", *(chr(c) for c in range(256) if _WHOLE.match(chr(c))))
_LOWER_LATIN = bytes(ord(chr(c).lower()) for c in range(256))


def _goes_whole(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(_WHOLE.search(text))
    return any(s in text for s in _WHOLE_LATIN)


def _lowered(text: str) -> str:
    """`text` in lower case, or as it is if it has characters beyond Latin-1."""
    try:
        return text.encode("latin-1").translate(_LOWER_LATIN).decode("latin-1")
    except UnicodeEncodeError:
        return text


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class WordBpe:
    """Ids as the tokenizer in a JSON file gives them, for word-end BPE over lower-cased words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        vocab, end = told["model"]["vocab"], told["model"]["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs]) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs])
        self.merges = Merges(left, right, np.arange(len(pairs)), made)
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int32)
        self.last = np.array([vocab[x + end] for x in letters], np.int32)
        self.pattern = regex.compile(f"\n|{told['pre_tokenizer']['pretokenizers'][0]['pattern']['Regex']}")
        self.speller = Speller(self.pieces)

    def pieces(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units (text between blanks) end to end, and how many each has."""
        told = np.zeros(len(units), bool)  # units that only the library itself spells surely: each as a word of its own
        joined = "\n".join(units)
        if not _PLAIN_LINES.match(joined):
            told[:] = [not _PLAIN.match(u) for u in units]
            joined = "\n".join("" if t else u for t, u in zip(told.tolist(), units, strict=True))
        words: defaultdict[str, int] = defaultdict(count().__next__, {"\n": -1})  # a new word gets the next number
        found = self.pattern.findall(joined.lower())
        every = np.fromiter(map(words.__getitem__, found), np.int32, len(found))
        del joined, found
        breaks = every < 0
        of = np.cumsum(breaks, dtype=np.int32)[~breaks]
        every = every[~breaks]
        flat = np.frombuffer("\n".join([*islice(words, 1, None), ""]).encode(), np.uint8)
        ends = np.flatnonzero(flat == 10) - np.arange(len(words) - 1)
        lengths = np.diff(ends, prepend=0)
        flat = flat[flat != 10]
        symbols = self.inner[flat]
        symbols[ends - 1] = self.last[flat[ends - 1]]
        ids, counts, odd = replay(symbols, lengths, self.merges)
        told[of[odd[every]]] = True
        if told.any():
            whole = np.flatnonzero(told)
            asked = self.tokenizer.encode_batch_fast([units[k] for k in whole.tolist()], add_special_tokens=False)
            kept = ~told[of]
            of = np.concatenate([of[kept], whole])
            order = np.argsort(of, kind="stable")
            of, every = of[order], np.concatenate([every[kept], len(counts) + np.arange(len(whole))])[order]
            ids = np.concatenate([ids, *(np.array(a.ids, np.int32) for a in asked)])
            counts = np.concatenate([counts, [len(a.ids) for a in asked]])
        return joined_words(ids, counts, every, np.bincount(of, minlength=len(units)))

    def encode(self, texts: list[str]) -> Iterator[list[np.ndarray]]:
        """Ids (unsigned 32-bit) of the texts, for some of them at a time in order."""
        whole = [_goes_whole(t) for t in texts]
        begin = 0
        for ids, counts in self.speller.spell([] if w else _lowered(t).split() for t, w in zip(texts, whole, strict=True)):
            rows = np.split(ids, np.cumsum(counts)[:-1])
            for k in range(len(rows)):
                if whole[begin + k]:
                    rows[k] = np.array(self.tokenizer.encode(texts[begin + k], add_special_tokens=False).ids, np.uint32)
            yield rows
            begin += len(rows)


@lru_cache(maxsize=1)
def _word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` tokens of each text: doc_id, piece, start, length, ids_crc32, deal (and ids).

    A document is its ids, then id 0. Only longer ones are cut. `deal` tells apart the tasks that made the pieces.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]

    def run(batch: pa.RecordBatch):
        bpe = _word_bpe(path)
        for held in row_steps(batch, "text", STEP_CHARS):
            first = 0
            for rows in bpe.encode([t or "" for t in held.column(1).to_pylist()]):
                of, piece, start, length, crc, kept = [], [], [], [], [], []
                for k, row in enumerate(rows, first):
                    row = np.append(row, np.uint32(0)).astype("<u4", copy=False)
                    for p, at in enumerate(range(0, len(row), capacity)):
                        part = row[at : at + capacity]
                        of.append(k)
                        piece.append(p)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
                        if ids:
                            kept.append(part.astype(np.int64))
                first += len(rows)
                columns = [held.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.list_(pa.int64()))] if ids else [])], names)

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids
    return arrow_map(docs.select("doc_id", "text"), run, schema).withColumn("deal", F.spark_partition_id())


class Plan:
    """Bins for given counts of lengths. groups: (first bin, bins, ((length, copies in each bin), ...))."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        gaps: dict[int, list[tuple[int, tuple]]] = {}
        order: list[int] = []
        done: list[tuple[int, tuple]] = []

        def put(gap: int, bins: int, items: tuple) -> None:
            if bins <= 0:
                return
            if gap == 0:
                done.append((bins, items))
                return
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((bins, items))

        third = capacity // 3
        large = {n: c for n, c in counts.items() if n > third and c > 0}
        sizes = sorted(large)
        while sizes:
            a = sizes[-1]
            n = large[a]
            b_at = bisect_left(sizes, capacity - a + 1) - 1  # the longest that fits beside it
            if b_at < 0:
                put(capacity - a, n, ((a, 1),))
                large[a] = 0
            elif (b := sizes[b_at]) == a:
                put(capacity - 2 * a, n // 2, ((a, 2),))
                large[a] = n % 2
                if n % 2:  # a single one is left: look for a shorter partner
                    if b_at:
                        b = sizes[b_at - 1]
                        put(capacity - a - b, 1, ((a, 1), (b, 1)))
                        large[b] -= 1
                    else:
                        put(capacity - a, 1, ((a, 1),))
                    large[a] = 0
            else:
                both = min(n, large[b])
                put(capacity - a - b, both, ((a, 1), (b, 1)))
                large[a] -= both
                large[b] -= both
            sizes = [s for s in sizes if large[s]]

        for s in sorted((n for n, c in counts.items() if 0 < n <= third and c > 0), reverse=True):
            left = counts[s]
            while left:
                at = bisect_left(order, s)
                if at == len(order):
                    each = capacity // s
                    put(capacity - each * s, left // each, ((s, each),))
                    if left % each:
                        put(capacity - (left % each) * s, 1, ((s, left % each),))
                    break
                gap = order[at]
                bins, items = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
                each = gap // s
                whole = min(bins, left // each)
                put(gap - each * s, whole, (*items, (s, each)))
                left -= whole * each
                bins -= whole
                if bins and 0 < left < each:
                    put(gap - left * s, 1, (*items, (s, left)))
                    bins -= 1
                    left = 0
                put(gap, bins, items)

        self.groups, first = [], 0
        for bins, items in [*done, *(g for gap in order for g in gaps[gap])]:
            self.groups.append((first, bins, items))
            first += bins
        self.bins = first
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        for begin, bins, items in self.groups:
            offset = 0
            for size, copies in items:
                rows.setdefault(size, []).append((begin, bins * copies, copies, offset))
                offset += size * copies
        lengths, starts, begins, copies, offsets = [], [], [], [], []
        for size in sorted(rows):
            rank = 0
            for begin, many, each, offset in rows[size]:
                lengths.append(size)
                starts.append(rank)
                begins.append(begin)
                copies.append(each)
                offsets.append(offset)
                rank += many
        self.key = (np.array(lengths, np.int64) << 44) | np.array(starts, np.int64)
        self.start, self.begin, self.copies, self.offset = (np.array(x, np.int64) for x in (starts, begins, copies, offsets))

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of the pieces with these lengths and these ranks among pieces of that length."""
        at = np.searchsorted(self.key, (length << 44) | rank, side="right") - 1
        nth = rank - self.start[at]
        return self.begin[at] + nth // self.copies[at], self.offset[at] + (nth % self.copies[at]) * length


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Pack all documents into few sequences of at most `capacity` tokens.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for). A null or
    empty text is the end token alone; null keys and repeated rows are packed as they come; other columns are left out;
    no document gives no sequence; very long texts are cut into pieces. Every rank is found from counts per task and length, so no length, however common,
    is gathered anywhere; the driver sees `capacity` counters at most.
    """
    pieces = checkpointed(token_pieces(docs, path, capacity, ids))
    counts = pieces.groupBy("deal", "length").agg(F.count(F.lit(1)).alias("n"))
    plan = Plan({r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("deal", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    among = Window.partitionBy("deal", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(among) - 1).join(counts, ["deal", "length"])
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]
    ranked = ranked.select(*kept, (F.col("rank") + F.col("before")).cast("bigint").alias("rank"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sequence, offset = plan.places(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return arrow_map(ranked, run, f"{schema}, sequence_id bigint, offset bigint")
