"""Line deduplication: sorted hash ranges, streamed first occurrences, compressed keep bitmaps.

Lines become 128-bit hashes of their keys. Within an Arrow batch all but the smallest document of a key are known to lose
it at once, so that one row a batch and key is left, however common the line. Those rows are dealt to ranges of the hash,
one a shuffle partition (hashes are uniform, so equal ranges need no sampling), sorted by hash, document and position, and
streamed: the first document of a hash keeps its lines. What returns is a zlib-compressed bitmap a document, no text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellstream.llm.common import arrow_map, quoted, row_steps, unused

BLANKS = " \t\n\x0b\x0c\r"
MIN_KEY = 10
#: Bytes of text whose lines are cut out in one step.
STEP_BYTES = 2_000_000


def line_keys(text: str | None) -> list[bytes | None]:
    """The key of each line, None where it is shorter than MIN_KEY code points."""
    out: list[bytes | None] = []
    for line in (text or "").split("\n"):
        line = line.strip(BLANKS)
        out.append(line.encode("utf-8", "surrogatepass").lower() if len(line) >= MIN_KEY else None)
    return out


def _occurrences(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row a text with the lines it loses within the batch, and one a key for the batch's smallest holders of it."""
    ids, marks, texts = (c.to_pylist() for c in batch.columns)
    first: dict[bytes, int] = {}
    seen: set[tuple] = set()
    held: list[tuple[int, int, int, dict[bytes, list[int]]]] = []
    for doc, mark, text in zip(ids, marks, texts, strict=True):
        if (doc, mark) in seen:
            continue
        seen.add((doc, mark))
        keys = line_keys(text)
        lines: dict[bytes, list[int]] = {}
        if doc is not None:
            for k, key in enumerate(keys):
                if key is not None:
                    lines.setdefault(xxhash.xxh3_128_digest(key), []).append(k)
            for h in lines:
                if first.get(h, doc) >= doc:
                    first[h] = doc
        held.append((doc, mark, len(keys), lines))
    out: tuple[list, ...] = ([], [], [], [], [], [])
    for doc, mark, n, lines in held:
        lost: list[int] = []
        for h, places in lines.items():
            if first[h] < doc:
                lost += places
            else:
                for column, value in zip(out, (h[:8], h[8:], doc, mark, None, np.array(places, "<u4").tobytes()), strict=True):
                    column.append(value)
        spread = xxhash.xxh3_64_digest(f"{doc}:{mark}".encode())
        for column, value in zip(out, (spread, None, doc, mark, n, np.array(lost, "<u4").tobytes()), strict=True):
            column.append(value)
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["h1", "h2", "doc_id", "mark", "n_lines", "places"])


def _stream_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash and document: those of a hash's later documents, and the rows of texts as they are."""
    last, owner = None, None
    for batch in batches:
        h1, h2, docs, totals = (batch.column(k).to_pylist() for k in ("h1", "h2", "doc_id", "n_lines"))
        keep = []
        for k, total in enumerate(totals):
            if total is not None:
                keep.append(k)
            elif (h1[k], h2[k]) != last:
                last, owner = (h1[k], h2[k]), docs[k]
            elif docs[k] != owner:
                keep.append(k)
        if keep:
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(k) for k in ("doc_id", "mark", "n_lines", "places")], ["doc_id", "mark", "n_lines", "places"])


def _bitmaps(batch: pa.RecordBatch) -> pa.RecordBatch:
    dropped, maps = [], []
    for n, parts in zip(batch.column("n_lines").to_pylist(), batch.column("places").to_pylist(), strict=True):
        keep = np.ones(n, bool)
        keep[np.frombuffer(b"".join(parts), "<u4")] = False
        dropped.append(int(n - keep.sum()))
        maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("mark"), batch.column("n_lines"), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())],
        ["doc_id", "mark", "n_lines", "n_dropped", "keep"],
    )


def marked(docs: DataFrame) -> DataFrame:
    """`docs` with `mark`, a hash that tells apart texts under one doc_id."""
    return docs.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """Which lines each text of `docs` (doc_id, text) keeps: doc_id, mark, n_lines, n_dropped, keep.

    `keep` is a zlib-compressed bitmap, least bit first. Keys in two documents or more lose all lines but those in the
    smallest doc_id. A null text counts as empty, which is one empty line. Rows that share doc_id are one document; copies
    of a row give one bitmap, other texts one each (`mark`). A row with a null doc_id keeps all its lines and takes none.
    """
    rows = marked(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).select("doc_id", "mark", F.coalesce("text", F.lit("")).alias("text"))
    found = arrow_map(rows, _occurrences, "h1 binary, h2 binary, doc_id bigint, mark bigint, n_lines bigint, places binary")
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nth = F.floor(F.conv(F.hex(F.substring("h1", 1, 4)), 16, 10).cast("bigint") * ranges / (1 << 32)).cast("int")
    sorted_rows = found.repartitionById(ranges, nth).sortWithinPartitions("h1", "h2", "doc_id", "places")
    lost = sorted_rows.mapInArrow(_stream_first, "doc_id bigint, mark bigint, n_lines bigint, places binary")
    told = lost.groupBy("doc_id", "mark").agg(F.max("n_lines").alias("n_lines"), F.collect_list("places").alias("places"))
    return arrow_map(told, _bitmaps, "doc_id bigint, mark bigint, n_lines bigint, n_dropped bigint, keep binary")


def kept_lines(text: str | None, n_lines: int, keep: bytes) -> str:
    flags = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines, bitorder="little")
    return "\n".join([line for line, flag in zip((text or "").split("\n"), flags.tolist(), strict=True) if flag])


def _with_bitmaps(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """`docs` with its lines, dropped lines and bitmap of each row, and the names of these three columns."""
    added = unused(docs.columns, "bitmap_doc", "bitmap_mark", "lines_", "dropped_", "keep_", "own_mark")
    doc, mark, *told, own = added
    maps = keep_bitmaps(docs).toDF(doc, mark, *told)
    held = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = held.join(maps, held["doc_id"].cast("bigint").eqNullSafe(maps[doc]) & (held[own] == maps[mark]))
    return joined.select(*map(quoted, [*docs.columns, *told])), told


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text of each row.

    Nulls, empty texts and repeated rows count as `keep_bitmaps` says; an empty table gives no row, very long texts are
    hashed whole, and other columns are left out.
    """
    joined, told = _with_bitmaps(docs.select("doc_id", "text"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in row_steps(batch, "text", STEP_BYTES):
            texts, lines, keep = (part.column(k).to_pylist() for k in ("text", told[0], told[2]))
            sums = [hashlib.sha256(kept_lines(t, n, k).encode("utf-8", "surrogatepass")).hexdigest() for t, n, k in zip(texts, lines, keep, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(part.column(k) for k in told[:2]), pa.array(sums, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(joined, run, f"doc_id {kind}, n_lines bigint, n_dropped bigint, kept_sha256 string")


def apply(docs: DataFrame) -> DataFrame:
    """`docs` without the lines that its bitmaps drop, all columns and rows kept (n_chars, if there, counts anew).

    A null text stays null; for the rest see `digests`.
    """
    names = docs.columns
    place = names.index("text")
    joined, told = _with_bitmaps(docs)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in row_steps(batch, "text", STEP_BYTES):
            texts, lines, lost, keep = (part.column(k).to_pylist() for k in ("text", *told))
            done = [kept_lines(t, n, k) if t is not None and d else t for t, n, d, k in zip(texts, lines, lost, keep, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()) if k == place else part.column(k) for k in range(len(names))], names)

    out = arrow_map(joined, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
