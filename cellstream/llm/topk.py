"""Exact top-k inner products: descending norms, SVD-rotated partial sums, Cauchy-Schwarz residual bounds.

Vectors are integers. They are sorted by norm into blocks; a bounded set of the longest gives every query a first k-th
score. A block whose longest vector can't reach that score with any query of a query block is never joined to it. Within
a pair of blocks, partial sums over the leading rotated dimensions plus the product of the residual norms bound each
score; only pairs above the bound get their exact integer product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellstream.llm.common import arrow_map, checkpointed, mixed

BLOCK = 2048
QUERY_BLOCK = 512
#: Longest vectors that every query is held against first.
SEEDS = 2048
#: Rotated dimensions of the first partial sum.
LEADING = 24
#: Bins of the norms of blocks, by which the driver learns how many blocks a query block needs.
BINS = 4096
#: Query blocks that one copy of a block of vectors serves; a block that more of them want is copied.
SERVED = 64
#: Sums below this are exact in double precision.
EXACT = float(1 << 52)


def integer_vectors(rows: DataFrame, key: str, column: str, scale: float) -> DataFrame:
    """key, norm (double), vec (int64 components as bytes) of every row whose vector is whole and finite.

    A row with a null key, or a vector that is null or empty or holds a null or non-finite component, takes no part.
    Rows of one key count once (the least vector by norm and bytes).
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, lists = batch.column(0), batch.column(1)
        flat = lists.flatten()  # of the lists that aren't null
        sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
        absent = pa.compute.is_null(flat).to_numpy(zero_copy_only=False)
        with np.errstate(invalid="ignore", over="ignore"):
            scaled = np.floor(scale * pa.compute.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64))
        odd = absent | ~np.isfinite(scaled)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        odds = np.concatenate(([0], np.cumsum(odd)))
        good = np.flatnonzero((sizes > 0) & (odds[ends] == odds[starts]) & pa.compute.is_valid(keys).to_numpy(zero_copy_only=False))
        packed, norms = [], []
        for k in good.tolist():
            v = scaled[starts[k] : ends[k]]
            norms.append(float(np.sqrt(v @ v)))
            packed.append(v.astype(np.int64).tobytes())
        return pa.RecordBatch.from_arrays([keys.take(pa.array(good)), pa.array(norms, pa.float64()), pa.array(packed, pa.binary())], ["id", "norm", "vec"])

    made = arrow_map(rows.select(F.col(key).cast("bigint"), column), run, "id bigint, norm double, vec binary")
    return made.groupBy("id").agg(F.min(F.struct("norm", "vec")).alias("v")).select("id", "v.norm", "v.vec")


def _matrix(packed: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(packed), width), np.int64)
    for k, p in enumerate(packed):
        row = np.frombuffer(p, np.int64)
        out[k, : len(row)] = row
    return out


def _narrowest(norm: float) -> type:
    """The integers in which vectors of at most this norm travel."""
    return next((t for t in (np.int16, np.int32) if norm < np.iinfo(t).max - 1), np.int64)


def _blocks(rows: DataFrame, size: int, width: int, kind: type) -> DataFrame:
    """Blocks of `size` vectors by descending norm: part, nth, top (largest norm), ids, vecs (as integers of a kind)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark

        part, nth, ids, norms, vecs = pyspark.TaskContext.get().partitionId(), 0, [], [], []

        def out(n: int) -> pa.RecordBatch:
            row = [[part], [nth], [norms[0]], [np.array(ids[:n], np.int64).tobytes()], [_matrix(vecs[:n], width).astype(kind).tobytes()]]
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], ["part", "nth", "top", "ids", "vecs"])

        for batch in batches:
            ids += batch.column("id").to_pylist()
            norms += batch.column("norm").to_pylist()
            vecs += batch.column("vec").to_pylist()
            while len(ids) >= size:
                yield out(size)
                nth += 1
                del ids[:size], norms[:size], vecs[:size]
        if ids:
            yield out(len(ids))

    ordered = rows.repartitionByRange((-F.col("norm")).asc(), F.col("id").asc()).sortWithinPartitions((-F.col("norm")).asc(), F.col("id").asc())
    return ordered.mapInArrow(run, "part int, nth int, top double, ids binary, vecs binary")


def _dots(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of `q` and `c`."""
    largest = np.abs(q).max(initial=0) * float(np.abs(c).max(initial=0)) * q.shape[1]
    return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64) if largest < EXACT else q @ c.T


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int, least: float) -> list[tuple[int, int]]:
    at = np.flatnonzero((scores >= least) & (ids != own))
    if len(at) > k:
        at = at[np.lexsort((ids[at], -scores[at]))[:k]]
    return [(int(ids[i]), int(scores[i])) for i in at]


def top_inner_products(rows: DataFrame, every: int, k: int = 5, key: str = "vec_id", column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The `k` largest integer inner products of each row whose key is divisible by `every`, against all other rows.

    Components count as floor(scale * x). Returns query_id, rank (from 1), vec_id, score; ties to the smaller id; fewer
    rows than k where there are fewer others. Shorter vectors count as filled up with zeros. Which rows take no part, and
    what repeated keys mean, says `integer_vectors`; an empty table gives an empty result. Products are exact below 2^63.
    """
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    spark = rows.sparkSession
    vectors = checkpointed(integer_vectors(rows, key, column, scale))
    width = (vectors.agg(F.max(F.length("vec"))).first()[0] or 0) // 8
    if not width:
        return spark.createDataFrame([], schema)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            held = batch.column(0).to_pylist()
            for at in range(0, len(held), BLOCK):
                m = _matrix(held[at : at + BLOCK], width).astype(np.float64)
                total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["row", "part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[r] = sums.get(r, 0.0) + np.frombuffer(p)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["row", "part"])

    parts = vectors.select("vec").mapInArrow(gram, "row int, part binary").repartition("row").mapInArrow(added, "row int, part binary")
    whole = np.zeros((width, width))
    for r in parts.collect():  # `width` rows
        whole[r["row"]] = np.frombuffer(bytes(r["part"]))
    rotation = np.linalg.svd(whole)[0]  # right singular vectors of all vectors, leading ones first
    leading = min(LEADING, width)

    highest = vectors.agg(F.max("norm")).first()[0]
    small = _narrowest(highest)
    blocks = checkpointed(_blocks(vectors, BLOCK, width, small))
    sizes = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    offsets, total = {}, 0
    for p in sorted(sizes):
        offsets[p], total = total, total + sizes[p]
    step = (highest or 1.0) / (BINS - 1)
    counted = {r["bin"]: r["n"] for r in blocks.groupBy(F.floor(F.col("top") / step).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()}
    reach = np.zeros(BINS + 2, np.int64)  # blocks whose largest norm is in this bin or above
    for b, n in counted.items():
        reach[: int(b) + 1] += n

    longest = vectors.orderBy(F.desc("norm"), "id").limit(SEEDS).collect()
    seed_ids, seeds = np.array([r["id"] for r in longest], np.int64), _matrix([bytes(r["vec"]) for r in longest], width)

    def first_scores(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for ids, vecs in zip(batch.column("ids").to_pylist(), batch.column("vecs").to_pylist(), strict=True):
            own, q = np.frombuffer(ids, np.int64), np.frombuffer(vecs, small).reshape(-1, width).astype(np.int64)
            scores = _dots(q, seeds)
            low, need = np.full(len(own), -np.inf), np.inf
            for n in range(len(own)):
                others = scores[n][seed_ids != own[n]]
                if len(others) >= k:
                    low[n] = np.partition(others, len(others) - k)[len(others) - k]
                norm = float(np.sqrt((q[n].astype(np.float64) ** 2).sum()))
                need = min(need, low[n] / norm if norm and low[n] > 0 else 0.0)
            wanted = int(reach[int(min(BINS, max(0.0, need * (1 - 1e-9)) // step))])
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.binary()), pa.array([vecs], pa.binary()), pa.array([low.tobytes()], pa.binary()), pa.array([wanted], pa.int32())], ["q_ids", "q_vecs", "low", "wanted"]
            )

    asked = _blocks(vectors.where(F.col("id") % every == 0), QUERY_BLOCK, width, small)
    asked = checkpointed(arrow_map(asked, first_scores, "q_ids binary, q_vecs binary, low binary, wanted int").where("wanted > 0"))
    # how many query blocks want each block: those that want more blocks than its number, of BINS numbers at most
    wants = sorted((r["wanted"], r["n"]) for r in asked.groupBy("wanted").agg(F.count(F.lit(1)).alias("n")).collect())
    edges = np.array([w for w, _ in wants], np.int64)
    served = np.append(np.cumsum([n for _, n in reversed(wants)])[::-1], 0)

    def copies(block: np.ndarray) -> np.ndarray:
        return -(-served[np.searchsorted(edges, block, side="right")] // SERVED)

    def offered(batch: pa.RecordBatch) -> pa.RecordBatch:
        block = np.array([offsets[p] for p in batch.column("part").to_pylist()], np.int64) + batch.column("nth").to_numpy()
        many = copies(block)
        where = np.repeat(np.arange(len(block)), many)
        copy = np.arange(len(where)) - np.repeat(np.cumsum(many) - many, many)
        rows = batch.take(pa.array(where))
        return pa.RecordBatch.from_arrays([pa.array(block[where]), pa.array(copy, pa.int64()), rows.column("ids"), rows.column("vecs")], ["block", "copy", "ids", "vecs"])

    def spread(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k, (wanted, ids) in enumerate(zip(batch.column("wanted").to_pylist(), batch.column("q_ids").to_pylist(), strict=True)):
            own = int(mixed(np.frombuffer(ids[:8], np.uint64))[0] >> np.uint64(1))
            for begin in range(0, wanted, SERVED):
                block = np.arange(begin, min(wanted, begin + SERVED), dtype=np.int64)
                copy = own % np.maximum(1, copies(block))
                row = batch.take(pa.array(np.full(len(block), k)))
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(copy, pa.int64()), *(row.column(n) for n in ("q_ids", "q_vecs", "low"))], ["block", "copy", "q_ids", "q_vecs", "low"])

    blocks = arrow_map(blocks, offered, "block bigint, copy bigint, ids binary, vecs binary")
    pairs = arrow_map(asked, spread, "block bigint, copy bigint, q_ids binary, q_vecs binary, low binary").join(blocks, ["block", "copy"])

    def search(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for q_ids, q_vecs, low, ids, vecs in zip(*(batch.column(n).to_pylist() for n in ("q_ids", "q_vecs", "low", "ids", "vecs")), strict=True):
            own, least, candidates = np.frombuffer(q_ids, np.int64), np.frombuffer(low), np.frombuffer(ids, np.int64)
            q, c = (np.frombuffer(v, small).reshape(-1, width).astype(np.int64) for v in (q_vecs, vecs))
            turned_q, turned_c = q @ rotation, c @ rotation
            bound = turned_q[:, :leading] @ turned_c[:, :leading].T
            rest_q, rest_c = (np.sqrt((t[:, leading:] ** 2).sum(axis=1)) for t in (turned_q, turned_c))
            bound += rest_q[:, None] * rest_c[None, :]
            slack = 1.0 + 1e-9 * np.sqrt((turned_q**2).sum(axis=1).max() * (turned_c**2).sum(axis=1).max())
            found: list[tuple[int, int, int]] = []
            for n in range(len(own)):
                at = np.flatnonzero(bound[n] >= least[n] - slack)
                if len(at):
                    found += [(int(own[n]), *x) for x in _best(_dots(q[n : n + 1], c[at])[0], candidates[at], int(own[n]), k, least[n])]
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in range(3)], ["query_id", "vec_id", "score"])

    found = arrow_map(pairs.select("q_ids", "q_vecs", "low", "ids", "vecs"), search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
