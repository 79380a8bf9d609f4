"""What several training-data operators share: word hashing, samples, scratch tables."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Odd 64-bit multipliers of the hashes and of the final mixing.
BASE = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB

#: Bytes of text that one vectorised step holds.
STEP_BYTES = 4_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint in the shared folder of the session.

    The folder is `spark.checkpoint.dir`; only on one machine (tests) a temporary one is set where the session names none.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", "")
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="cellstream-"))
    return df.checkpoint(eager=True)


def drop_checkpoint(df: DataFrame) -> None:
    """Delete the files of `checkpointed` data that nothing reads any more."""
    context = df.sparkSession.sparkContext
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = context._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def arrow_map(
    df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str | T.StructType
) -> DataFrame:
    """Apply `function` to each Arrow batch of `df`; it returns one batch, none, or an iterator of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()
        for batch in batches:
            if not batch.num_rows:
                continue
            out = function(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            elif out is not None:
                yield from out
            del batch, out
            pool.release_unused()  # a worker lives on, beside others, after its task

    # names with dots can't be passed on; functions that keep columns of any name take them by their place
    plain = [unused(df.columns, f"column_{k}")[0] if "." in n or "`" in n else n for k, n in enumerate(df.columns)]
    return df.toDF(*plain).mapInArrow(run, schema)


def quoted(name: str) -> F.Column:
    """The column of exactly this name."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(columns: list[str] | tuple[str, ...], *names: str) -> list[str]:
    """Each of `names`, lengthened until no column has it in any case of its letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def steps(texts: list[str | None], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `limit` characters, or a single longer text."""
    begin, size = 0, 0
    for k, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > limit:
            yield begin, k
            begin, size = k, 0
        size += n + 1
    if begin < len(texts):
        yield begin, len(texts)


def row_steps(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of `batch` that hold about `limit` bytes in `column`, or a single longer value."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy()
    ends = np.cumsum(sizes.astype(np.int64) + 1)
    begin = 0
    while begin < len(ends):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX_1)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


#: Bytes of a word up to which eight at a time are hashed.
LONG_WORD = 256
#: What is kept of eight bytes of which the first 0 to 8 belong to a word.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of some texts, as flat arrays.

    hashes: 64-bit hash of each word; of: index of its text; counts: words of each text.
    """

    __slots__ = ("counts", "hashes", "of")

    def __init__(self, texts: list[str | None], lower: bool = False):
        encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        joined = b"\n" + b"\n".join(encoded) + b"\n"
        if lower:
            joined = joined.lower()  # of bytes: A-Z alone
        raw = np.frombuffer(joined, np.uint8)
        blank = (raw == 32) | ((raw - np.uint8(9)) < np.uint8(5))
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        starts, ends = edge[0::2], edge[1::2]
        bounds = np.cumsum([len(e) + 1 for e in encoded])
        self.of = np.searchsorted(bounds, starts - 1, side="right")
        self.counts = np.bincount(self.of, minlength=len(texts))
        self.hashes = _word_hashes(joined, starts, ends)


def _word_hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word: eight of its bytes at a time are mixed in, and those of words above LONG_WORD by XXH3.

    Sums of powers of one base won't do: some pairs of words (those of Thue and Morse) collide under every base.
    """
    lengths = ends - starts
    eights = np.frombuffer(joined + bytes(16 - len(joined) % 8), np.uint64)
    out = mixed(lengths.astype(np.uint64) * np.uint64(BASE))
    longest = int(lengths.max()) if len(lengths) else 0
    left, at, size = slice(None), starts, lengths
    for done in range(0, min(longest, LONG_WORD), 8):
        if done:
            left = np.flatnonzero((lengths > done) & (lengths <= LONG_WORD))
            at, size = starts[left] + done, lengths[left] - done
        shift = ((at & 7) << 3).astype(np.uint64)
        slot = at >> 3
        chunk = eights[slot] >> shift
        chunk |= (eights[slot + 1] << (np.uint64(63) - shift)) << np.uint64(1)
        chunk &= _MASKS[np.minimum(size, 8)]
        with np.errstate(over="ignore"):
            out[left] = mixed((out[left] ^ chunk) * np.uint64(BASE))
    if longest > LONG_WORD:
        for k in np.flatnonzero(lengths > LONG_WORD).tolist():
            out[k] = xxhash.xxh3_64_intdigest(joined[starts[k] : ends[k]])
    return out


def shingles(hashes: np.ndarray, of: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` successive words of one text, and the text of each; a shorter text gives one of all its words."""
    n = len(hashes)
    if n == 0:
        return hashes, of
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, n - size + 1), np.uint64)
        for k in range(size):
            rolled = rolled * np.uint64(BASE) + hashes[k : k + len(rolled)]
        whole = of[: len(rolled)] == of[size - 1 :] if len(rolled) else np.zeros(0, bool)
        out, out_of = mixed(rolled[whole]), of[: len(rolled)][whole]
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            first = np.cumsum(counts) - counts
            extra = np.zeros(len(short), np.uint64)
            for k in range(size - 1):
                has = counts[short] > k
                extra[has] = extra[has] * np.uint64(BASE) + hashes[first[short[has]] + k]
            out, out_of = np.concatenate([out, mixed(extra + counts[short].astype(np.uint64))]), np.concatenate([out_of, short])
    return out, out_of


def fold(column: str, parts: int) -> F.Column:
    """crc32 of an id written as text, modulo `parts`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(parts)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature by which `logits` (rows x classes) explain `truth` best; 1 without rows."""
    if len(truth) == 0:
        return 1.0
    best, found = 1.0, np.inf
    for t in np.geomspace(0.05, 20.0, 121):
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        loss = float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(truth)), truth]))
        if loss < found - 1e-12:
            best, found = float(t), loss
    return best


def large_binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
