"""N-gram Jaccard join by adaptive multi-match prefixes.

Documents with one shingle set are a class. Shingles are ordered by zones, then by hash: first those of a lower part of
the hash space that few documents hold, then the rest of the space, then those that many hold, by their number of holders.
The lower part is wide enough for the prefix of most documents, so holders are counted there over all documents, and in
the rest of the space over the classes whose prefixes reach into it: no other prefix can hold such a shingle. A class
indexes its prefix of that order; by its estimated candidate cost it lengthens the prefix by some tokens and asks for as
many more matches. A pair needs, before it is verified on the whole sets, as many shared prefix tokens as the sizes of both
sets and the lengths of both prefixes imply. Tokens with very many holders that still stand in a prefix, which are those of
large groups of near copies, aren't turned into pairs, whose number would grow with the square of the group: holders of
similar size count as one candidate component. Components are verified whole if they are small, else in bounded blocks,
giving a spanning forest of the links only.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellstream.llm.common import Words, arrow_map, checkpointed, drop_checkpoint, mixed, quoted, row_steps, shingles, steps, unused

#: Frequent shingles that are told apart at most in either part of the hash space: 16 bytes each.
FREQUENT = 1 << 20
#: Holders above which a shingle is frequent.
FEW_HOLDERS = 12
#: Parts in which counters are summed.
PARTS = 64
#: Flags of the filter that keeps texts without candidates from being shuffled.
FILTER_BITS = 22
#: Longest lengthening of a prefix, and what verifying a candidate costs in index entries.
MOST_MATCHES = 7
VERIFY_COST = 20.0
#: Further holders that a shingle is thought to have where nothing else is known.
OTHERS = 0.2
#: Holders of a token up to which it gives pairs.
PAIR_HOLDERS = 64
#: Weight of a component of the candidate graph up to which one task verifies it whole, and of a block of a larger one.
GROUP_WEIGHT = 400_000
#: A document weighs its shingles and this.
ROW_WEIGHT = 400
#: Documents of a large component that all its blocks share at first.
HUBS = 16
#: Partitions of the edges of a graph: at least so many, and one more for each so many edges.
LEAST_PARTS = 8
PART_EDGES = 100_000
STEP_CHARS = 1_000_000
#: Compressed bytes of texts whose components are verified in one step.
PACKED_STEP = 400_000


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted; empty without words."""
    words = Words(texts, lower=True)
    hashes, of = shingles(words.hashes, words.of, words.counts, size)
    if size > 1:  # short texts come last; bring each text's shingles together
        order = np.argsort(of, kind="stable")
        hashes, of = hashes[order], of[order]
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    return [_distinct(hashes[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _distinct(hashes: np.ndarray) -> np.ndarray:
    hashes = np.sort(hashes)
    again = hashes[1:] == hashes[:-1]
    return np.delete(hashes, np.flatnonzero(again)) if again.any() else hashes


def counted_part(percent: int) -> int:
    """The shingle hash below which holders are counted over all documents: room for prefixes of twice the least length."""
    return min((1 << 64) - 1, int((0.05 + 2 * (1 - percent / 100)) * (1 << 64)))


def _told(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of counts (token, n) to be summed the `most` highest at most, above FEW_HOLDERS: sorted tokens and their counts."""
    counts = counts.groupBy("token").agg(F.sum("n").alias("n"))
    counts = checkpointed(counts.where(F.col("n") > FEW_HOLDERS).withColumn("level", F.floor(F.log2("n")).cast("int")))
    room, least = most, 64
    for r in sorted(counts.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):  # 64 rows
        if r["n"] > room:
            break
        room, least = room - r["n"], r["level"]
    table = counts.where(F.col("level") >= least).select("token", "n").toArrow()
    tokens = table.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], table.column("n").to_numpy()[order]


def _token_counts(sets: list[np.ndarray]) -> pa.RecordBatch:
    tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts, pa.int64())], ["token", "n"])


def frequent_shingles(docs: DataFrame, size: int, percent: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` shingles at most of the counted part that most documents hold, over all documents: sorted hashes, counts.

    Only the order of prefixes hangs on it, not the result.
    """
    below = np.uint64(counted_part(percent))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(0).to_pylist()
        return _token_counts([s[: np.searchsorted(s, below)] for begin, end in steps(texts, STEP_CHARS) for s in shingle_sets(texts[begin:end], size)])

    return _told(arrow_map(docs.select("text"), run, "token bigint, n bigint"), most)


def frequent_rest(classes: DataFrame, percent: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """As `frequent_shingles`, of the rest of the hash space over the classes that carry their whole sets."""
    below = np.uint64(counted_part(percent))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.frombuffer(p, np.uint64) for p in batch.column(0).to_pylist()]
        return _token_counts([s[np.searchsorted(s, below) :] for s in sets])

    return _told(arrow_map(classes.where("matches = 0").select("prefix"), run, "token bigint, n bigint"), most)


def summed_counters(rows: DataFrame, size: int, count) -> np.ndarray:
    """Counters of a fixed number that `count(batch, counters)` adds to in each task, summed over all tasks."""
    width = size // PARTS
    schema = "part int, counts binary"

    def packed(p: int, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], ["part", "counts"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for batch in batches:
            if batch.num_rows:
                count(batch, total)
        for p in range(PARTS):
            yield packed(p, total[p * width : (p + 1) * width])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(c), np.uint32)
                sums[p] = sums[p] + part if p in sums else part
        for p, s in sums.items():
            yield packed(p, s)

    out = np.zeros(size, np.uint32)
    for r in rows.mapInArrow(each, schema).repartition("part").mapInArrow(add, schema).collect():  # PARTS rows
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.uint32)
    return out


def _slots(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mixed(ids.astype(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def filtered_texts(own: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, packed (compressed words) and the further columns of `wanted` (id, mark, ...): its texts among `own`.

    A filter of 2^FILTER_BITS flags, whatever the input, keeps most other texts from being shuffled; the join is exact.
    """

    def flag(batch: pa.RecordBatch, total: np.ndarray) -> None:
        total[_slots(batch.column(0).to_numpy())] = 1

    flags = np.packbits(summed_counters(wanted.select("id"), 1 << FILTER_BITS, flag) > 0)

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        batch = batch.filter(pa.compute.is_valid(batch.column("id")))
        slots = _slots(batch.column("id").to_numpy())
        batch = batch.take(pa.array(np.flatnonzero(flags[slots >> 3] & (128 >> (slots & 7)))))
        made = pa.array([packed_text(t) for t in batch.column("text").to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), made], ["id", "mark", "packed"])

    near = arrow_map(own.select(F.col("doc_id").alias("id"), "mark", "text"), pack, "id bigint, mark bigint, packed binary")
    return near.join(wanted, ["id", "mark"]).dropDuplicates(["id", "mark"]).drop("mark")


def holders_of(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Holders of each token, 0 where it isn't frequent."""
    known, held = frequent
    if not len(known):
        return np.zeros(len(tokens))
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    return np.where(known[at] == tokens, held[at], 0).astype(np.float64)


def reach(n: int, percent: int) -> tuple[int, int]:
    """Length of the prefix of a set of n tokens that asks for one match, and the most matches that any set asks for."""
    least = -(-percent * n // 100)  # shared shingles that any link needs
    return n - least + 1, min(MOST_MATCHES, least)


def _cheapest(first: int, most: int, cost: np.ndarray) -> int:
    """The number of matches to ask for, by index entries and by candidates, which `cost` has up to each token."""
    return int(np.argmin([first + m + cost[first + m - 2] * (1.0 + VERIFY_COST / m**2) for m in range(1, most + 1)])) + 1


def adaptive_prefix(tokens: np.ndarray, holders: np.ndarray, percent: int) -> tuple[int, np.ndarray]:
    """How many matches a set asks for, and which of its tokens are its prefix; `holders`: of each token, 0 if not known."""
    first, most = reach(len(tokens), percent)
    zone = np.where(holders > 0, 2 + np.floor(np.log2(1.0 + holders)).astype(np.int64), tokens >= np.uint64(counted_part(percent)))
    order = np.lexsort((tokens, zone))
    matches = _cheapest(first, most, np.cumsum(np.maximum(holders, OTHERS)[order][: first + most - 1]))
    return matches, order[: first + matches - 1]


def asked_matches(n: int, m: int, k: int, o: int, percent: int) -> int:
    """Shared prefix tokens without which sets of n and k tokens, with prefixes for m and o matches, can't link.

    The prefix that ends first in the common order holds all but (least shared size - matches) tokens of its set; a link
    shares percent / (100 + percent) of both sizes, so what is not there must be among the shared tokens of the prefixes.
    """
    link = -(-percent * (n + k) // (100 + percent))
    return link - max(-(-percent * n // 100) - m, -(-percent * k // 100) - o)


def _classes(docs: DataFrame, size: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, mark (of the text), n, print (of the set, null without one), matches, prefix of each row.

    Where the prefix may reach beyond the few-held tokens of the counted part, matches is 0 and prefix is the whole set.
    """
    below = np.uint64(counted_part(percent))

    def run(batch: pa.RecordBatch):
        texts = batch.column("text").to_pylist()
        for begin, end in steps(texts, STEP_CHARS):
            counts, prints, matches, prefixes = [], [], [], []
            for tokens in shingle_sets(texts[begin:end], size):
                counts.append(len(tokens))
                if not len(tokens):
                    prints.append(None)
                    matches.append(0)
                    prefixes.append(b"")
                    continue
                prints.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                few = tokens[: np.searchsorted(tokens, below)]
                few = few[holders_of(few, frequent) == 0]
                if len(few) < sum(reach(len(tokens), percent)) - 1:
                    matches.append(0)
                    prefixes.append(tokens.tobytes())
                else:
                    m, length = _few_held_prefix(len(tokens), percent)
                    matches.append(m)
                    prefixes.append(few[:length].tobytes())
            own = [batch.column(k).slice(begin, end - begin) for k in ("doc_id", "mark")]
            made = [pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), pa.array(matches, pa.int32()), pa.array(prefixes, pa.binary())]
            yield pa.RecordBatch.from_arrays([*own, *made], ["doc_id", "mark", "n", "print", "matches", "prefix"])

    return arrow_map(docs.select("doc_id", "mark", "text"), run, "doc_id bigint, mark bigint, n bigint, print binary, matches int, prefix binary")


@lru_cache(maxsize=1 << 16)
def _few_held_prefix(n: int, percent: int) -> tuple[int, int]:
    """Matches and length of the prefix of n tokens where few hold each that matters."""
    first, most = reach(n, percent)
    matches = _cheapest(first, most, OTHERS * np.arange(1, first + most))
    return matches, first + matches - 1


def _prefixes(batch: pa.RecordBatch, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each class the matches it asks for, and its prefix in tokens that give pairs and tokens with too many holders."""
    nothing = np.zeros(0, np.uint64)
    for matches, prefix in zip(batch.column("matches").to_pylist(), batch.column("prefix").to_pylist(), strict=True):
        tokens = np.frombuffer(prefix, np.uint64)
        if matches:
            yield matches, tokens, nothing
            continue
        holders = holders_of(tokens, frequent)
        matches, chosen = adaptive_prefix(tokens, holders, percent)
        many = holders[chosen] > PAIR_HOLDERS
        yield matches, tokens[chosen[~many]], tokens[chosen[many]]


def _postings(percent: int, frequent: tuple[np.ndarray, np.ndarray]):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        matches, held, _ = zip(*_prefixes(batch, percent, frequent), strict=True)
        where = pa.array(np.repeat(np.arange(len(held)), [len(h) for h in held]))
        shape = (batch.column("n").to_numpy() << 3) | np.array(matches)  # in one column: a shuffled row is shorter
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64)), batch.column("id").take(where), pa.array(shape).take(where)], ["token", "id", "shape"])

    return run


def _hot_edges(percent: int, frequent: tuple[np.ndarray, np.ndarray]):
    """Edges (a, b) that join the classes of similar size that hold one token with too many holders for pairs.

    A token has a node for each range of sizes; a class stands in its own range and in the next. It and its other nodes
    have an edge to the least of its nodes: those of a group of near copies are mostly the same, and so few edges.
    """
    ratio = 1.001 * np.log(100 / percent) if percent < 100 else 1e-9

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        a, b = [], []
        for i, n, (_, _, many) in zip(batch.column("id").to_pylist(), batch.column("n").to_pylist(), _prefixes(batch, percent, frequent), strict=True):
            if len(many):
                low = np.uint64(int(np.log(n) / ratio))
                nodes = sorted(mixed(np.concatenate((many + low, many + low + np.uint64(1)))).view(np.int64).tolist())
                a += [i, *nodes[1:]]
                b += [nodes[0]] * len(nodes)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]) if a else None

    return run


def _candidates(percent: int, most: int):
    """Streams postings sorted by token and size: rows (0, a, b, matches asked) of pairs, (1, first, id, 0) of big tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, held, first = None, [], None
        out: list[tuple[int, int, int, int]] = []

        def close() -> None:
            nonlocal held, first
            for x, (i, n, m) in enumerate(held):
                for j, k, o in held[x + 1 :]:
                    if 100 * n < percent * k:  # sizes ascend
                        break
                    if i != j:
                        out.append((0, min(i, j), max(i, j), asked_matches(n, m, k, o, percent)))
            held, first = [], None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["kind", "a", "b", "c"])

        for batch in batches:
            tokens, ids, shape = (batch.column(k).to_numpy() for k in ("token", "id", "shape"))
            sizes, matches = shape >> 3, shape & 7
            cuts = np.concatenate(([0], np.flatnonzero(tokens[1:] != tokens[:-1]) + 1, [len(tokens)]))
            lengths = np.diff(cuts)
            runs = np.flatnonzero(lengths > 1).tolist()
            ends = {0, len(lengths) - 1}
            for r in sorted(ends.union(runs)):
                a, b = int(cuts[r]), int(cuts[r + 1])
                if token is None or tokens[a] != token:
                    close()
                    token = int(tokens[a])
                if first is None and len(held) + b - a <= most:
                    held += list(zip(ids[a:b].tolist(), sizes[a:b].tolist(), matches[a:b].tolist(), strict=True))
                    continue
                if first is None:
                    first = held[0][0] if held else int(ids[a])
                    out += [(1, first, h[0], 0) for h in held]
                    held = []
                out += [(1, first, i, 0) for i in ids[a:b].tolist()]
                if len(out) > 50_000:
                    yield flush()
            if len(out) > 50_000:
                yield flush()
        close()
        if out:
            yield flush()

    return run


def _similar(shared: np.ndarray, n: np.ndarray, k: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (n + k - shared)


def packed_text(text: str | None) -> bytes:
    """The words of a text, compressed: a third of what its shingle hashes take."""
    return zlib.compress((text or "").encode("utf-8", "surrogatepass").lower(), 1)


def packed_sets(packed: list[bytes], size: int) -> list[np.ndarray]:
    texts = [zlib.decompress(p).decode("utf-8", "surrogatepass") for p in packed]
    return [s for begin, end in steps(texts, STEP_CHARS) for s in shingle_sets(texts[begin:end], size)]


def block_links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among these sets, as (smallest id of the tree, id)."""
    m = len(ids)
    sizes = np.array([len(s) for s in sets])
    if m == 2:
        both = np.sort(np.concatenate(sets))
        alike = _similar(np.count_nonzero(both[1:] == both[:-1]), *sizes, percent)
        return [(int(ids.min()), int(ids.max()))] if alike and ids[0] != ids[1] else []
    tokens, number, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(m), sizes)
    used = counts[number] > 1
    number, of = number[used], of[used]
    often = counts[counts > 1].astype(np.float64)
    shared = np.zeros((m, m), np.float32)
    if (often**2).sum() <= m * m * len(often) / 40.0:
        order = np.argsort(number, kind="stable")
        number, of = number[order], of[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(number)) + 1, [len(number)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            who = of[a:b]
            shared[np.ix_(who, who)] += 1
    else:
        _, number = np.unique(number, return_inverse=True)
        order = np.argsort(number, kind="stable")
        number, of = number[order], of[order]
        for low in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
            a, b = np.searchsorted(number, (low, low + 4096))
            part = np.zeros((m, min(4096, int(number[-1]) + 1 - low)), np.float32)
            part[of[a:b], number[a:b] - low] = 1
            shared += part @ part.T
    link = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    root = np.full(m, -1)
    out = []
    for start in np.argsort(ids, kind="stable").tolist():
        if root[start] >= 0:
            continue
        root[start], todo = start, [start]
        while todo:
            fresh = np.flatnonzero(link[todo.pop()] & (root < 0))
            root[fresh] = start
            todo += fresh.tolist()
            out += [(int(ids[start]), int(ids[x])) for x in fresh if ids[x] != ids[start]]
    return out


def _component_links(size: int, percent: int):
    """Streams (component, id, packed) sorted by component: the links within each, many small components in one step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        components, ids, packed = [], [], []

        def links(n: int) -> pa.RecordBatch:
            sets, own = packed_sets(packed[:n], size), np.array(components[:n])
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), n]
            out = [x for a, b in zip(cuts[:-1], cuts[1:], strict=True) for x in block_links(np.array(ids[a:b]), sets[a:b], percent)]
            del components[:n], ids[:n], packed[:n]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for part in row_steps(batch, "packed", PACKED_STEP):
                components += part.column("component").to_pylist()
                ids += part.column("id").to_pylist()
                packed += part.column("packed").to_pylist()
                whole = bisect_left(components, components[-1])  # the last one may go on
                if whole:
                    yield links(whole)
        if components:
            yield links(len(components))

    return run


def joined_apart(rows: DataFrame, told: DataFrame, key: str) -> DataFrame:
    """`rows` joined with `told`, which was grouped by the whole number `key`, so that a key of very many rows may be split.

    The join is on another expression than the grouping: both sides are shuffled for it alone, which lets the planner deal a
    skewed partition to several tasks at run time.
    """
    told = told.withColumnRenamed(key, "__key")
    return rows.join(told, rows[key].bitwiseXOR(F.lit(1)) == told["__key"].bitwiseXOR(F.lit(1))).drop("__key")


def connected(edges: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of an undirected graph (a, b), by large and small stars.

    Only nodes with an edge come back. Edges are written to the checkpoint folder at each turn, and those of the turn before
    deleted; nothing goes to the driver but whether a turn was the last.
    """
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def both_ways(edges: DataFrame, flag: str) -> DataFrame:
        ends = F.array(F.struct("u", "v", F.lit(True).alias(flag)), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(False).alias(flag)))
        return edges.select(F.explode(ends).alias("e")).select("e.*")

    while True:
        # done when every node has one edge down, to a node that has none
        ends = both_ways(edges, "down").groupBy("u").agg(F.count_if("down").alias("down"), F.bool_or(~F.col("down")).alias("up"))
        more, n = ends.agg(F.bool_or((F.col("down") > 1) | (F.col("down") == 1) & F.col("up")), F.sum("down")).first()
        if not more:
            break
        before, edges = edges, edges.coalesce(LEAST_PARTS + n // PART_EDGES)
        least = both_ways(edges, "down").groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = joined_apart(both_ways(edges, "down").where("not down"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = joined_apart(large, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        edges = checkpointed(small)
        drop_checkpoint(before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())


def _large_links(own: DataFrame, large: DataFrame, found: DataFrame, in_block) -> DataFrame:
    """Links that span the large components of the candidate graph: `large` has id, mark, component, parts, part.

    A component's documents are dealt to blocks of bounded weight, each with the hubs too: the HUBS documents with most
    candidates. Most documents so meet in one tree. Only those outside the component's largest tree then go to every
    block: two documents inside it are connected already.
    """
    schema = "a bigint, b bigint"
    texts = checkpointed(filtered_texts(own, large.select("id", "mark", "component", "parts", "part")))
    degree = found.select(F.col("a").alias("id"), "seen").union(found.select("b", "seen")).groupBy("id").agg(F.sum("seen").alias("degree"))
    order = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("degree"), "id", "part"))
    ranked = texts.select("id", "component", "part").join(degree, "id").withColumn("nth", order).where(F.col("nth") <= HUBS)
    hubs = texts.join(ranked.select("id").distinct(), "id")
    hubs = hubs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    names = ["component", "part", "id", "packed"]
    blocks = texts.select(names).join(hubs.select("id").distinct(), "id", "left_anti").select(names).union(hubs.select(names))
    links = checkpointed(blocks.groupBy("component", "part").applyInPandas(in_block, schema))

    trees = texts.select("id", "component").join(connected(links).withColumnRenamed("component", "tree"), F.col("id") == F.col("node"), "left")
    trees = checkpointed(trees.select("id", "component", F.coalesce("tree", "id").alias("tree")))
    sizes = trees.groupBy("component", "tree").agg(F.count(F.lit(1)).alias("rows"))
    main = sizes.groupBy("component").agg(F.max_by("tree", F.struct("rows", "tree")).alias("main"))
    loose = joined_apart(trees, main, "component").where("tree <> main").select("id")
    loose = checkpointed(loose.join(texts, "id"))
    if loose.isEmpty():
        return links
    # loose blocks against all blocks: pair (i, j) of parts, the loose documents of i with all documents of j
    alone = loose.select("component", "parts", F.col("part").alias("i")).distinct()
    every = alone.join(texts.select("component", F.col("part").alias("j"), "id", "packed"), "component").select("component", "i", "j", "id", "packed")
    spread = loose.select("component", F.col("part").alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), "id", "packed")
    met = every.union(spread.where("i <> j"))
    return links.union(met.groupBy("component", "i", "j").applyInPandas(in_block, schema))


def link_components(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, mark, n_shingles and component_id of each row of `docs` (doc_id, text).

    Two documents link when 100 * shared >= percent * united distinct `size`-word shingles; component_id is the smallest
    doc_id reachable by links, itself included. Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a text of fewer words
    is one shingle of all of them; one without words, or null, has none and links with nothing. Rows that share doc_id
    count as one document that any of its texts may link, and get one component. A row with a null doc_id has a null
    component and links with nothing. An empty table gives no row, other columns are left out, and very long texts are
    compared whole. Words and shingles are told apart by 64-bit hashes, sets by 128-bit ones.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    lower = frequent_shingles(own, size, percent, FREQUENT)
    rows = checkpointed(_classes(own, size, percent, lower))
    some = rows.where(F.col("print").isNotNull() & F.col("doc_id").isNotNull())
    first = some.groupBy("print").agg(F.min(F.struct(F.col("doc_id").alias("id"), "mark", "n", "matches", "prefix")).alias("c"))
    classes = checkpointed(first.select("print", "c.*"))
    upper = frequent_rest(classes, percent, FREQUENT)
    frequent = tuple(np.concatenate(both) for both in zip(lower, upper, strict=True))  # all hashes of the rest are higher

    indexed = classes.select("id", "n", "matches", "prefix")
    postings = arrow_map(indexed, _postings(percent, frequent), "token bigint, id bigint, shape bigint")
    postings = postings.repartition("token").sortWithinPartitions("token", "shape", "id")
    found = postings.mapInArrow(_candidates(percent, PAIR_HOLDERS), "kind int, a bigint, b bigint, c int")
    found = found.groupBy("kind", "a", "b").agg(F.count(F.lit(1)).alias("seen"), F.min("c").alias("asked"))
    hot = arrow_map(indexed.where("matches = 0"), _hot_edges(percent, frequent), "a bigint, b bigint")
    hot = hot.groupBy("a", "b").agg(F.count(F.lit(1)).alias("seen"))
    found = checkpointed(found.where("seen >= asked").select("a", "b", "seen").union(hot))

    # Documents of one component of the candidate graph go to one place, each once, if the component is small enough.
    groups = connected(found.select("a", "b")).withColumnRenamed("node", "id").join(classes.select("id", "mark", "n"), "id")
    groups = groups.withColumn("n", F.col("n") + ROW_WEIGHT)
    weights = groups.groupBy("component").agg(F.sum("n").alias("weight"))
    groups = joined_apart(groups, weights, "component").withColumn("parts", F.ceil(F.col("weight") / GROUP_WEIGHT).cast("int"))
    groups = checkpointed(groups.select("id", "mark", "component", "parts", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part")))

    def in_block(held: pd.DataFrame) -> pd.DataFrame:
        made = block_links(held["id"].to_numpy(), packed_sets(held["packed"].tolist(), size), percent)
        return pd.DataFrame(made, columns=["a", "b"]).astype("int64")

    together = filtered_texts(own, groups.where("parts = 1").select("id", "mark", "component"))
    together = together.select("component", "id", "packed").repartition("component").sortWithinPartitions("component")
    links = checkpointed(together.mapInArrow(_component_links(size, percent), "a bigint, b bigint"))
    large = groups.where("parts > 1")
    if not large.isEmpty():
        links = links.union(_large_links(own, large, found, in_block))
    # the texts of one document meet in its own node, which is that of any class it names
    repeated = checkpointed(rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id"))
    siblings = not repeated.isEmpty()
    if siblings:
        links = links.union(some.select("doc_id", "print").join(repeated, "doc_id").join(classes, "print").select("doc_id", "id").where("doc_id <> id").distinct())
    parts = connected(links)
    if siblings:
        parts = checkpointed(parts)
    named = classes.select("print", "id").join(parts.withColumnRenamed("node", "id"), "id", "left")
    named = checkpointed(named.select("print", F.coalesce("component", "id").alias("component_id")))
    for done in (found, groups, classes):
        drop_checkpoint(done)
    out = rows.select("doc_id", "mark", F.col("n").alias("n_shingles"), "print").join(named, "print", "left")
    if siblings:  # a text without words goes with its document
        met = repeated.join(parts, F.col("doc_id") == F.col("node")).select("doc_id", "component")
        out = out.join(met, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "component"))
    return out.select("doc_id", "mark", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """`docs` without the rows that link, directly or through others, to a document of smaller doc_id.

    All columns stay; rows with a null doc_id stay. A document is all the rows of its doc_id: it stays or goes as a whole,
    also where only one of its texts links to a smaller doc_id. Rows of one doc_id and one text count once, whatever
    their other columns hold.
    """
    names = [quoted(n) for n in docs.columns]
    own, text = unused(docs.columns, "id_", "text_mark")
    kept = link_components(docs, size, percent).where("component_id = doc_id").select(F.col("doc_id").alias(own)).distinct()
    whole = docs.where(F.col("doc_id").isNotNull()).join(kept, F.col("doc_id").cast("bigint") == F.col(own))
    whole = whole.withColumn(text, F.xxhash64("text")).dropDuplicates(["doc_id", text])
    return whole.select(*names).unionByName(docs.where(F.col("doc_id").isNull()))
