"""Exact substring deduplication: suffixes sorted by hash-compared prefixes, around content-defined anchors.

Every byte is removed that a `length`-byte string covers which also starts earlier (smaller doc_id, or same document
and earlier start). Of each such string the K-byte substring with the smallest hash is its anchor, wherever the
string occurs, so two equal strings have equal anchors at the same place; about 2 of 60 positions are anchors.
Anchors that occur once are dropped by sorting; those that a batch of documents repeats needn't all meet for that.
The others carry their surroundings, all that the strings they
stand for can cover, and equal ones meet. There the suffixes that begin at anchors, and the reversed
prefixes that end there, are sorted by mergesort: two of them are compared by a binary search for their common
extension over prefix polynomial hashes, and the extensions of neighbours are verified byte by byte. Neighbours
that share length - o bytes rightwards and o bytes leftwards hold equal strings at offset o; all but the first
of a class are covered. (Verification: a neighbour whose bytes differ where hashes agree makes the chunk sort
plainly by bytes.)

A frequent anchor is dealt in parts by document, each of at most about `hot`; a part passes on only occurrences
that are the first of some class in it, and these meet once more. Groups are streamed in document order in
chunks, so that a task holds a chunk and the first occurrences of classes so far.

Results on unusual input: null texts are empty, and documents shorter than `length` lose nothing. Rows that share a
doc_id are documents that follow one another by text, and identical ones follow in any order; rows without doc_id
come first. An empty table gives an empty result. Texts are taken whole, up to the 2 GB that a row can hold.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textscan
from quarry.llm.common import Workspace, small

K = 40
PLACE = np.uint64((1 << 28) - 1)
#: Bytes that are looked at together; with a window more, places in them have to fit into PLACE.
PART = 1 << 27


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all anchors of the rows in a slice."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(data) > PART:  # windows that begin in a part, each whole in it, have the anchors they have in the slice
        found = [_anchors(data[a : a + PART + length - 1], offsets - a, length) for a in range(0, len(data) - length + 1, PART)]
        at, h = np.concatenate([a + k * PART for k, (a, _) in enumerate(found)]), np.concatenate([h for _, h in found])
        new = np.append(True, at[1:] != at[:-1]) if len(at) else np.zeros(0, bool)
        return at[new], h[new]
    return _anchors(data, offsets, length)


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    p = textscan.prefix(data)
    start = np.arange(len(data) - K + 1)
    h = textscan.mix(substring_k(p, start))
    least = textscan.sliding_min((h & ~PLACE) | start.astype(np.uint64), length - K + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.clip(offsets, 0, len(data))))
    inside = row[: len(least)] == row[length - 1 :][: len(least)]
    at = (least[inside] & PLACE).astype(np.int64)
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    return at, h[at]


def substring_k(p: np.ndarray, start: np.ndarray) -> np.ndarray:
    _, down = textscan.powers(len(p))
    return (p[start + K] - p[start]) * down[start]


def _anchor_rows(length: int):
    """Each anchor with a salt that says what is known of it before the shuffle.

    Of anchors that occur again within a batch, one (salt 1) meets those of other batches; the others (2 and more,
    differing by document) are known to be repeated and are spread evenly. So a frequent anchor sends one row per
    batch to the task of its hash. Salt 0: the only one in its batch.
    """
    schema = pa.schema([("h", pa.int64()), ("uid", pa.int64()), ("pos", pa.int32()), ("salt", pa.int32())])

    def run(batches):
        for batch in batches:
            found = []
            for ids, data, offsets in textscan.slices(batch.column(0), batch.column(1)):
                at, h = anchors(data, offsets, length)
                row = np.searchsorted(offsets, at, "right") - 1
                found.append((h, ids.to_numpy()[row], (at - offsets[row]).astype(np.int32)))
            if not found:
                continue
            h, uid, pos = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(h, kind="stable")
            h, uid, pos = h[order], uid[order], pos[order]
            first = np.append(True, h[1:] != h[:-1])[: len(h)]
            spread = (textscan.mix(uid.astype(np.uint64) + pos.astype(np.uint64)) & np.uint64(0x1FFFFFFF)).astype(np.int32)
            single = first & np.append(first[1:], True)[: len(h)]
            salt = np.where(single, 0, np.where(first, 1, 2 * spread + 2)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(uid), pa.array(pos), pa.array(salt)], schema=schema)

    return run


def _repeated():
    """Of rows ordered by h, those whose h occurs again here or is known to."""

    def run(batches):
        last = None  # the row before, if it was the first of its h: (h, row)
        for batch in batches:
            h, salt = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            if not len(h):
                continue
            same = h[1:] == h[:-1]
            keep = salt > 0
            keep[1:] |= same
            keep[:-1] |= same
            if last is not None and last[0] == h[0]:
                keep[0] = True
                if last[1] is not None:
                    yield last[1]
            rows = batch.select([0, 1, 2])
            yield rows.filter(pa.array(keep))
            last = (h[-1], None if keep[-1] else rows.slice(len(h) - 1))

    return run


def _contexts(length: int):
    """Rows come ordered by (uid, pos), the text first: each anchor with the bytes around it."""
    left, width = length - K, 2 * length - K
    schema = pa.schema([("h", pa.int64()), ("uid", pa.int64()), ("pos", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("around", pa.binary())])
    shift = np.arange(width)

    def run(batches):
        held, size = None, 0
        for batch in batches:
            # a text's row has no h; a column with nulls would become floats, which don't hold 64 bits
            uid, pos, h = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).fill_null(0).to_numpy()
            texts = batch.column(3)
            first = np.flatnonzero(np.asarray(texts.is_valid()))
            cuts = [0, *first.tolist(), len(uid)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < len(uid) and texts[a].is_valid:
                    body = np.frombuffer(texts[a].as_buffer(), np.uint8)
                    size = len(body)
                    held = np.zeros(size + left + length, np.uint8)
                    held[left : left + size] = body
                    a += 1
                if a < b:
                    at = pos[a:b].astype(np.int64)
                    for c in range(0, len(at), 4096):
                        some = at[c : c + 4096]
                        around = held[some[:, None] + shift]
                        offsets = np.arange(len(some) + 1, dtype=np.int32) * width
                        blob = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(around))])
                        yield pa.RecordBatch.from_arrays([pa.array(h[a + c : a + c + len(some)].astype(np.int64)), pa.array(uid[a + c : a + c + len(some)].astype(np.int64)), pa.array(some.astype(np.int32)), pa.array(np.minimum(some, left).astype(np.int32)), pa.array(np.minimum(size - some, length).astype(np.int32)), blob], schema=schema)

    return run


class Side:
    """Strings that run from an anchor in one direction, compared by prefix hashes."""

    def __init__(self, columns: np.ndarray):
        self.bytes = np.ascontiguousarray(columns)  # a row per string, from the anchor on
        up, _ = textscan.powers(columns.shape[1])
        self.sums = np.zeros((len(columns), columns.shape[1] + 1), np.uint64)
        np.cumsum(textscan.BYTE[self.bytes] * up[: columns.shape[1]], axis=1, out=self.sums[:, 1:])
        self.size = columns.shape[1]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of common prefixes, by binary search over equal hashes."""
        low, high = np.zeros(len(i), np.int64), np.full(len(i), self.size)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.sums[i, mid] == self.sums[j, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether string i stands before string j."""
        n = self.common(i, j)
        at = np.minimum(n, self.size - 1)
        return np.where(n == self.size, or_equal, self.bytes[i, at] < self.bytes[j, at])

    def order(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Strings sorted within their groups (which are runs of equal numbers) and, for each, what it has in common with the one before."""
        n = len(group)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(first, n))
        base, total = np.repeat(first, size), np.repeat(size, size)
        # bottom-up mergesort of all groups at once
        out, width, local = np.arange(n), 1, np.arange(n) - base
        while width < size.max(initial=0):
            active = np.flatnonzero(total > width)
            run = local[active] // width
            sibling = base[active] + (run ^ 1) * width
            end = np.minimum(sibling + width, base[active] + total[active])
            low, high = np.minimum(sibling, end), end.copy()
            begin, later = low.copy(), run % 2 == 1
            while (busy := np.flatnonzero(low < high)).size:
                mid = (low[busy] + high[busy]) // 2
                # the earlier run's strings go first among equals
                before = self.less(out[mid], out[active[busy]], later[busy])
                low[busy], high[busy] = np.where(before, mid + 1, low[busy]), np.where(before, high[busy], mid)
            place = base[active] + (run - run % 2) * width + local[active] - run * width + low - begin
            new = out.copy()
            new[place] = out[active]
            out, width = new, 2 * width
        common = np.zeros(n, np.int64)
        inner = np.flatnonzero(local > 0)
        common[inner] = self.common(out[inner - 1], out[inner])
        # verification: the bytes that hashes call equal are equal
        same = self.bytes[out[inner - 1]] == self.bytes[out[inner]]
        true = np.where(same.all(1), self.size, same.argmin(1))
        if (true != common[inner]).any():
            out = np.lexsort((*self.bytes.T[::-1], group))
            same = self.bytes[out[inner - 1]] == self.bytes[out[inner]]
            common[inner] = np.where(same.all(1), self.size, same.argmin(1))
        return out, common


def covered(group: np.ndarray, left: np.ndarray, right: np.ndarray, around: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For occurrences ordered by (group, document, position): lowest and highest offset at which the string around
    the anchor occurs earlier (length and -1 if none), and whether it is the first of some class."""
    n, reach = len(group), length - K
    low, high, first = np.full(n, length), np.full(n, -1), np.zeros(n, np.bool_)
    to_right, common_right = Side(around[:, reach:]).order(group)
    to_left, common_left = Side(around[:, :reach][:, ::-1]).order(group)
    class_right, class_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(reach + 1):
        valid = np.flatnonzero((o <= left) & (length - o <= right))
        if not len(valid):
            continue
        class_right[to_right] = np.cumsum(common_right < length - o)
        class_left[to_left] = np.cumsum(common_left < o) if o else 0
        key = class_right[valid] * (n + 1) + class_left[valid]
        _, begin = np.unique(key, return_index=True)
        new = np.zeros(len(valid), np.bool_)
        new[begin] = True
        first[valid[new]] = True
        old = valid[~new]
        low[old], high[old] = np.minimum(low[old], o), o
    return low, high, first


MARKS = "uid long, start int, stop int, h long, pos int, left int, right int, around binary"
_MARKS = pa.schema([("uid", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("h", pa.int64()), ("pos", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("around", pa.binary())])


def _covered_rows(length: int, chunk: int = 16384):
    """Rows (h, part, passes, uid, pos, left, right, around) come ordered by (h, part, uid, pos). Gives covered stretches,
    and of groups that pass on, their first occurrences with all columns."""
    width = 2 * length - K

    def solve(rows, fresh):
        table = pa.Table.from_batches(rows).combine_chunks()
        h, part, passes, uid, pos, left, right = (table.column(i).to_numpy() for i in range(7))
        around = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint8).reshape(len(h), width)
        group = np.cumsum(np.append(True, (h[1:] != h[:-1]) | (part[1:] != part[:-1])))
        low, high, first = covered(group, left, right, around, length)
        mark = np.flatnonzero((high >= 0) & fresh)
        give = np.flatnonzero(first & fresh & (passes > 0))
        none = lambda k, t: pa.nulls(len(k), t)
        found = pa.RecordBatch.from_arrays([pa.array(uid[mark]), pa.array((pos[mark] - high[mark]).astype(np.int32)), pa.array((pos[mark] - low[mark] + length).astype(np.int32)), *(none(mark, f.type) for f in list(_MARKS)[3:])], schema=_MARKS)
        on = table.take(pa.array(give))
        passed = pa.RecordBatch.from_arrays([pa.array(uid[give]), none(give, pa.int32()), none(give, pa.int32()), *(on.column(i).combine_chunks() if len(give) else none(give, f.type) for i, f in zip((0, 4, 5, 6, 7), list(_MARKS)[3:], strict=True))], schema=_MARKS)
        tail = (group == group[-1]) & first
        return [found, passed], table.filter(pa.array(tail)).to_batches()

    def run(batches):
        kept: list = []  # first occurrences of the group that may go on
        held, waiting = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                held.append(batch.slice(at, chunk))
                waiting += held[-1].num_rows
                if waiting >= chunk:
                    rows = kept + held
                    fresh = np.repeat([False, True], [sum(b.num_rows for b in kept), waiting])
                    out, kept = solve(rows, fresh)
                    yield from out
                    held, waiting = [], 0
        if waiting:
            out, _ = solve(kept + held, np.repeat([False, True], [sum(b.num_rows for b in kept), waiting]))
            yield from out

    return run


def runs(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for a, b in sorted(zip(start.tolist(), stop.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(with_text: bool):
    """Rows come ordered by (uid, start), the text first: what is left of each document."""
    schema = pa.schema([("uid", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if with_text else [])])

    def row(uid, texts, spans):
        found = runs(*(np.array(x, np.int64) for x in (zip(*spans, strict=True) if spans else ((), ()))))
        for text in texts:
            left, at = [], 0
            for a, b in found:
                left.append(text[at:a])
                at = b
            rest = b"".join([*left, text[at:]])
            yield (uid, len(text), len(text) - len(rest), len(found), hashlib.sha256(rest).hexdigest(), rest)[: len(schema)]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    def run(batches):
        held, texts, spans, done = None, [], [], []
        for batch in batches:
            for uid, start, stop, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if uid != held:
                    done += row(held, texts, spans)
                    held, texts, spans = uid, [], []
                if text is not None:
                    texts.append(text)
                else:
                    spans.append((start, stop))
            if len(done) >= 500:
                yield batch_of(done)
                done = []
        yield batch_of([*done, *row(held, texts, spans)])

    return run


def deduplicate(docs: DataFrame, length: int = 100, hot: int = 20_000, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row and, on request, the bytes kept (as kept)."""
    if length <= K:
        raise ValueError(f"length must be more than {K}")
    work = Workspace(docs.sparkSession, "suffix")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    renumbered = bool(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").head(1))
    if renumbered:
        ordered = texts.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
        texts = work.save(ordered.withColumn("uid", F.monotonically_increasing_id()), "numbered")
    else:
        texts = texts.withColumn("uid", F.col("doc_id"))

    found = texts.where(F.octet_length("text") >= length).select("uid", "text").mapInArrow(_anchor_rows(length), "h long, uid long, pos int, salt int")
    dealt_by = F.shiftright("salt", 1)  # 0 for those that have to meet
    again = work.save(found.repartition("h", dealt_by).sortWithinPartitions("h").mapInArrow(_repeated(), "h long, uid long, pos int"), "repeated")
    some = texts.select("uid", "text").join(small(work.save(again.select("uid").distinct(), "repeated-ids")), "uid", "left_semi")
    none = F.lit(None)
    rows = some.select("uid", F.lit(-1).alias("pos"), none.cast("long").alias("h"), "text").unionByName(again.select("uid", "pos", "h", none.cast("binary").alias("text")))
    around = rows.repartition("uid").sortWithinPartitions("uid", "pos").mapInArrow(_contexts(length), "h long, uid long, pos int, left int, right int, around binary")

    often = work.save(again.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("h", F.ceil(F.col("n") / hot).cast("int").alias("parts")), "often")
    dealt = around.join(small(often), "h", "left").select("h", F.coalesce(F.pmod(F.xxhash64("uid"), "parts").cast("int"), F.lit(0)).alias("part"), F.col("parts").isNotNull().cast("int").alias("passes"), "uid", "pos", "left", "right", "around")
    order = ["h", "part", "uid", "pos"]
    solved = work.save(dealt.repartition("h", "part").sortWithinPartitions(*order).mapInArrow(_covered_rows(length), MARKS), "covered")
    passed = solved.where("h IS NOT NULL").select("h", F.lit(0).alias("part"), F.lit(0).alias("passes"), "uid", "pos", "left", "right", "around")
    second = passed.repartition("h").sortWithinPartitions(*order).mapInArrow(_covered_rows(length), MARKS)
    marks = work.save(solved.where("start IS NOT NULL").select("uid", "start", "stop").unionByName(second.where("start IS NOT NULL").select("uid", "start", "stop")), "marks")
    work.drop("repeated", "covered", "often")

    ids = small(work.save(marks.select("uid").distinct(), "marked-ids"))
    whole = texts.join(ids, "uid", "left_anti").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), *([F.col("text").alias("kept")] if with_text else []))
    marked = texts.join(ids, "uid", "left_semi").select("uid", F.lit(-1).alias("start"), F.lit(-1).alias("stop"), "text")
    both = marked.unionByName(marks.select("uid", "start", "stop", none.cast("binary").alias("text"))).repartition("uid").sortWithinPartitions("uid", "start")
    cut = both.mapInArrow(_cut(with_text), "uid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
    if renumbered:
        cut = cut.join(texts.select("uid", "doc_id"), "uid").select("doc_id", *cut.columns[1:])
    else:
        cut = cut.withColumnRenamed("uid", "doc_id")
    return cut.unionByName(whole)
