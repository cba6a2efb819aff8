"""Best-fit packing by minimum bin slack (Gupta and Ho, 1999) on the histogram of piece lengths.

Documents are encoded, an end id follows each, and documents longer than a sequence are cut into full pieces
with a shorter first one. How many pieces have which length is all that a plan needs: at most `capacity`
numbers, whatever the corpus. The plan fills one bin at a time: a bitset dynamic programme over the available
lengths, longest first, finds the fullest feasible combination, which is taken as often as the counts allow and
removed. A search that ends once a bin is full up to a small slack spends longer pieces (Fleszar and Hindi, 2002), so
plans are made for several slacks, and the one with the fewest sequences counts. There are few combinations,
each with a run of sequence numbers. Pieces of one length are numbered,
within hashed parts of at most about `per_part` pieces, and the number gives sequence and offset.

Results on unusual input: null and empty texts are one piece that holds only the end id. Rows that share a
doc_id are packed each; rows without doc_id as well. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Workspace, prepare
from quarry.llm.tokens import with_end

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _cut(path: str, end: int, capacity: int, with_ids: bool):
    schema = PIECES.append(pa.field("ids", pa.binary())) if with_ids else PIECES

    def run(batches):
        for batch in batches:
            flat, sizes = with_end(batch.column(1), path, end)
            raw = flat.tobytes()
            count = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), count)
            piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            rest = np.where(sizes % capacity, sizes % capacity, capacity)[row]  # of the first piece
            start = np.where(piece > 0, rest + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, rest)
            at = 4 * (start + (np.cumsum(sizes) - sizes)[row])
            parts = [raw[a:b] for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(list(map(zlib.crc32, parts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(parts, pa.binary())] * with_ids, schema=schema)

    return run


def pieces(docs: DataFrame, path: str, end: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, on request, the ids themselves."""
    prepare(docs.sparkSession)
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_cut(path, end, capacity, with_ids), kind)


#: Slacks that plans are made for: the first is the plain heuristic.
SLACKS = (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)


def fullest(lengths: list[int], counts: dict[int, int], capacity: int, slack: int = 0) -> list[int]:
    """The lengths, longest first, of a combination that fills a bin as far as can be, or up to slack without shorter ones.

    Bit s of `reach` tells that the lengths taken so far can sum to s. A length with count c is added 1, 2, 4, ...
    and the rest at a time; walking back through the steps gives the combination.
    """
    reach, full, steps = 1, (1 << (capacity + 1)) - 1, []
    for length in lengths:
        left, many = min(counts[length], capacity // length), 1
        while left:
            take = min(many, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & full
            left, many = left - take, 2 * many
        if reach >> max(0, capacity - slack):
            break
    at, out = reach.bit_length() - 1, []
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            out += [length] * take
            at -= length * take
    return sorted(out, reverse=True)


Slot = tuple[int, int, int, int, int]


def plan(histogram: dict[int, int], capacity: int) -> list[Slot]:
    """Slots (length, first number, count, first sequence, offset): piece `first + i` of a length, i < count,
    goes to sequence `first sequence + i` at the offset. Numbers of each length run from 0 without gaps.

    The plan with the fewest sequences of those for all slacks, or the first that no plan can beat.
    """
    least = -(-sum(k * v for k, v in histogram.items()) // capacity)
    best: tuple[int, list[Slot]] | None = None
    for slack in SLACKS:
        found = plan_with(histogram, capacity, slack)
        if best is None or found[0] < best[0]:
            best = found
        if best[0] <= least:
            break
    return best[1]


def plan_with(histogram: dict[int, int], capacity: int, slack: int) -> tuple[int, list[Slot]]:
    """(sequences, slots) of one slack. Each bin starts from the longest piece left, as in the minimum bin slack heuristic."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    used = dict.fromkeys(counts, 0)
    lengths = sorted(counts, reverse=True)
    slots, sequence = [], 0
    while lengths:
        seed = lengths[0]
        rest = dict(counts)
        rest[seed] -= 1
        fits = [x for x in lengths if rest[x] and x <= capacity - seed]
        combination = [seed, *fullest(fits, rest, capacity - seed, slack)]
        times = min(counts[x] // combination.count(x) for x in set(combination))
        offset = 0
        for x in combination:
            slots.append((x, used[x], times, sequence, offset))
            used[x] += times
            counts[x] -= times
            offset += x
        sequence += times
        lengths = [x for x in lengths if counts[x]]
    return sequence, slots


def _place(slots: list[Slot], names: list[str]):
    by_length: dict[int, tuple[np.ndarray, ...]] = {}
    for length in {s[0] for s in slots}:
        own = np.array(sorted(s[1:] for s in slots if s[0] == length), np.int64)
        by_length[length] = tuple(own.T)

    def run(batches):
        for batch in batches:
            length, number = (batch.column(names.index(x)).to_numpy() for x in ("length", "number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                first, _, sequences, offsets = by_length[int(length[rows[0]])]
                at = np.searchsorted(first, number[rows], "right") - 1
                sequence[rows], offset[rows] = sequences[at] + number[rows] - first[at], offsets[at]
            keep = [i for i, x in enumerate(names) if x != "number"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)], names=[*(names[i] for i in keep), "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2, per_part: int = 20_000, with_ids: bool = False) -> DataFrame:
    """Each piece with sequence_id and offset: gapless from 0 in its sequence, at most capacity ids in each."""
    work = Workspace(docs.sparkSession, "packing")
    cut = work.save(pieces(docs, path, end, capacity, with_ids), "pieces")
    total = cut.count()
    parts = max(1, -(-total // per_part))
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = plan(histogram, capacity)
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "part", F.coalesce("before", F.lit(0)).alias("before"))
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")))
    numbered = ranked.join(before, ["length", "part"]).select(*keys, *["ids"] * with_ids, (F.col("before") + F.col("rank") - 1).alias("number"))
    out = [f for f in numbered.schema if f.name != "number"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in out), "sequence_id long", "offset long"])
    return numbered.mapInArrow(_place(slots, numbered.columns), schema)
