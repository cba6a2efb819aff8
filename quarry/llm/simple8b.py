"""Token ids as binary files: Simple-8b word-aligned coding (Anh and Moffat, 2010).

A 64-bit word holds a 4-bit selector and 60 bits with as many ids as fit at one width. Blocks of BLOCK ids
start at a word of their own, whose offset the index has, so blocks are encoded and decoded side by side with
NumPy. Ids of more than 60 bits are escapes: their word holds a place in the segment's list of raw values.

File: segments one after another, each with whole documents in ascending doc_id order. Little-endian.

    8 bytes   magic "QS8B0001"
    5 x u64   documents D, ids N, blocks B, words W, escapes E
    D x i64   doc_id            D x u8   1 if the row had a doc_id
    D x u64   ids of each document
    B x u64   first word of each block
    E x u64   escaped values
    W x u64   words

Documents are ranged over tasks by doc_id; a task writes its files into the shared folder under a name of its
own attempt, and only the files in the manifest, written by finished tasks, count. Nothing is gathered on the
driver but the manifest: a row per file of about `file_bytes`.

Results on unusual input: null and empty texts hold only the end id. Rows that share a doc_id are kept each,
next to each other, the smaller text first; rows without doc_id come first. An empty table gives no files and an empty result.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Workspace
from quarry.llm.tokens import with_end

MAGIC = b"QS8B0001"
BLOCK = 4096
#: Fixed values of the format: (ids, bits) of the selectors 1 to 15; selector 0 is the escape.
SELECTORS = [(120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNT = np.array([1, *(c for c, _ in SELECTORS)], np.int64)


def _widths(ids: np.ndarray) -> np.ndarray:
    high = (ids >> np.uint64(32)).astype(np.float64)
    low = (ids & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1]).astype(np.int8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each block, escaped values, words) of non-negative 64-bit ids."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    escape = ids >> np.uint64(60) != 0
    raw = ids[escape]
    body = np.zeros(blocks * BLOCK, np.uint64)
    body[:n] = ids
    width = np.zeros((blocks, BLOCK + COUNT.max()), np.int8)  # beyond a block's ids anything fits
    flat = np.zeros(blocks * BLOCK, np.int8)
    flat[:n] = np.where(escape, 64, _widths(ids))
    width[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    chosen = np.zeros((blocks, BLOCK), np.int8)
    most, span = width, 1  # the highest width of the span from each place on
    for s in range(len(SELECTORS), 0, -1):  # from the fewest ids a word to the most, at most twice the one before
        count, bits = SELECTORS[s - 1]
        if count > span:
            most, span = np.maximum(most[:, : most.shape[1] - (count - span)], most[:, count - span :]), count
        np.copyto(chosen, np.int8(s), where=most[:, :BLOCK] <= bits)
    total = blocks * BLOCK
    after = np.arange(total) + COUNT[chosen.reshape(-1)]
    after[after >= np.minimum(np.repeat(np.arange(1, blocks + 1) * BLOCK, BLOCK), n)] = total
    after = np.append(after, total)
    at, starts = np.arange(blocks) * BLOCK, []
    while (at < total).any():  # all blocks step from word to word together
        for _ in range(64):
            starts.append(at)
            at = after[at]
    start = np.concatenate(starts)
    start = np.sort(start[start < total])
    selector = chosen.reshape(-1)[start]
    words = selector.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([body, np.zeros(120, np.uint64)])
    order = np.zeros(len(body), np.int64)
    order[:n] = np.cumsum(escape) - 1
    for s in np.unique(selector):
        own = np.flatnonzero(selector == s)
        if s == 0:
            words[own] |= order[start[own]].astype(np.uint64)
            continue
        count, bits = SELECTORS[s - 1]
        end = (start[own] // BLOCK + 1) * BLOCK
        for j in range(count if bits else 0):
            words[own] |= np.where(start[own] + j < end, padded[start[own] + j], np.uint64(0)) << np.uint64(j * bits)
    first = np.searchsorted(start, np.arange(blocks) * BLOCK)
    return first.astype(np.uint64), raw, words


def decode(n: int, first: np.ndarray, raw: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The n ids."""
    blocks = len(first)
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNT[selector]
    before = np.cumsum(count) - count
    block = np.searchsorted(first.astype(np.int64), np.arange(len(words)), "right") - 1
    at = before - before[first.astype(np.int64)][block] + block * BLOCK if blocks else before
    out = np.zeros(blocks * BLOCK + 120, np.uint64)
    for s in np.unique(selector):
        own = np.flatnonzero(selector == s)
        if s == 0:
            out[at[own]] = raw[(words[own] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        ids, bits = SELECTORS[s - 1]
        end = (block[own] + 1) * BLOCK
        for j in range(ids if bits else 0):
            inside = at[own] + j < end
            out[at[own][inside] + j] = words[own][inside] >> np.uint64(j * bits) & np.uint64((1 << bits) - 1)
    return out[:n]


def pack_segment(keys: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    first, raw, words = encode(ids)
    head = np.array([len(keys), len(ids), len(first), len(words), len(raw)], "<u8")
    known = np.array([k is not None for k in keys], np.uint8)
    return b"".join([MAGIC, head.tobytes(), np.array([k or 0 for k in keys], "<i8").tobytes(), known.tobytes(), np.array(lengths, "<u8").tobytes(), first.astype("<u8").tobytes(), raw.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def read_segments(stream):
    """(doc_ids, lengths, ids) of each segment of an open file."""
    while magic := stream.read(8):
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        d, n, b, w, e = (int(x) for x in np.frombuffer(stream.read(40), "<u8"))
        keys = np.frombuffer(stream.read(8 * d), "<i8").tolist()
        known = np.frombuffer(stream.read(d), np.uint8)
        lengths = np.frombuffer(stream.read(8 * d), "<u8").astype(np.int64)
        first, raw, words = (np.frombuffer(stream.read(8 * k), "<u8") for k in (b, e, w))
        yield [k if x else None for k, x in zip(keys, known, strict=True)], lengths, decode(n, first, raw, words)


def filesystem(uri: str):
    """(file system, path) of a URI or a plain path."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return fs.LocalFileSystem(), uri


def _write(path: str, end: int, folder: str, segment_ids: int, file_bytes: int):
    schema = pa.schema([("path", pa.string()), ("part", pa.int32()), ("file", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        part, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        store, place = filesystem(folder)
        keys, lengths, held, waiting = [], [], [], 0
        out, made, totals, size = None, [], [0, 0], 0

        def flush():
            nonlocal keys, lengths, held, waiting, out, totals, size
            if keys:
                if out is None:
                    name = f"{place}/ids-{part:06d}-{len(made):06d}-{own}.s8b"
                    out, totals, size = store.open_output_stream(name), [0, 0], 0
                    made.append([name, part, len(made), 0, 0])
                segment = pack_segment(keys, lengths, np.concatenate(held))
                out.write(segment)
                size += len(segment)
                made[-1][3] += len(keys)
                made[-1][4] += waiting
                keys, lengths, held, waiting = [], [], [], 0

        for batch in batches:
            flat, sizes = with_end(batch.column(1), path, end)
            ids, ends, at = batch.column(0).to_pylist(), np.cumsum(sizes), 0
            while at < len(sizes):  # as many documents as the segment still takes
                before = int(ends[at - 1]) if at else 0
                to = max(at, int(np.searchsorted(ends, before + segment_ids - waiting))) + 1
                to = min(to, len(sizes))
                keys += ids[at:to]
                lengths += sizes[at:to].tolist()
                held.append(flat[before : ends[to - 1]])
                waiting += int(ends[to - 1]) - before
                at = to
                if waiting >= segment_ids:
                    flush()
                    if size >= file_bytes:
                        out.close()
                        out = None
        flush()
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made, strict=True) if made else [[]] * 5, schema, strict=True)], schema=schema)

    return run


def write_ids(docs: DataFrame, path: str, end: int = 0, segment_ids: int = 500_000, file_bytes: int = 64 << 20, work: Workspace | None = None) -> DataFrame:
    """Write the files; returns the manifest: path, part, file (their order), documents, ids."""
    work = work or Workspace(docs.sparkSession, "token-ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    return work.save(ordered.mapInArrow(_write(path, end, work.mkdir("files"), segment_ids, file_bytes), "path string, part int, file int, documents long, ids long"), "manifest")


def _read(folder: str):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        store, _ = filesystem(folder)
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(name) as stream:
                    for keys, lengths, ids in read_segments(stream):
                        ends = np.cumsum(lengths)
                        raw, cuts = ids.astype("<u4").tobytes(), (4 * np.append(0, ends)).tolist()
                        crcs = [zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(at + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())], schema=schema)
                        at += int(ends[-1]) if len(ends) else 0

    return run


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """Each document as the files have it: doc_id, start (ids before it), n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    files, at = [], 0
    for r in sorted(manifest.collect(), key=lambda r: (r.part, r.file)):  # a row per file
        files.append((r.path, at))
        at += r.ids
    listed = spark.createDataFrame(files, "path string, start long").repartition(max(1, len(files)))
    return listed.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end: int = 0, **options) -> DataFrame:
    """Write all documents' ids and read them back."""
    work = Workspace(docs.sparkSession, "token-ids")
    manifest = write_ids(docs, path, end, work=work, **options)
    return read_ids(manifest, work.path("files"))
